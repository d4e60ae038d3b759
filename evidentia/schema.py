"""Table layouts and closed sets of values. Instants are UTC microseconds; ids compare by their bytes."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "t": T.TimestampNTZType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (f.split(":") for f in spec.split())])


#: Statements: subject and object are terms (kind, ref), either may be grounded by a mention.
OBSERVATION = _struct(
    "obs_id:s subject_kind:s subject_ref:s predicate:s object_kind:s object_ref:s temporal_kind:s valid_start:t valid_end:t recorded_at:t status:s"
)
EVIDENCE_LINK = _struct("obs_id:s evidence_id:s role:s")
#: Append-only decision chains; supersedes_id names the decision that a row replaces.
RESOLUTION_DECISION = _struct("id:s proposal_id:s mention_id:s outcome:s entity_id:s recorded_at:t supersedes_id:s")
#: As stored: also who decided and why.
STORED_DECISION = T.StructType([*RESOLUTION_DECISION.fields, *_struct("authority:s reason:s").fields])
ADMISSION_DECISION = _struct("id:s target_kind:s target_id:s outcome:s recorded_at:t supersedes_id:s")
STORED_ADMISSION = T.StructType([*ADMISSION_DECISION.fields, *_struct("authority:s reason:s").fields])
ENTITY = _struct("id:s kind:s display_name:s recorded_at:t")
SPAN = _struct("evidence_id:s version_id:s section_id:s start_byte:l end_byte:l quote:s recorded_at:t")
SECTION = _struct("version_id:s section_id:s title:s parent_id:s path:a section_order:l role:s content:s")
VERSION = _struct("version_id:s source_id:s digest:s title:s locator:s provider_version:s modified_at:t source_time:t recorded_at:t")
SOURCE = _struct("source_id:s provider:s provider_id:s recorded_at:t")
#: Where a source's pointer was moved to; only appended, the last row holds.
POINTER = _struct("source_id:s version_id:s recorded_at:t seq:l")
REVISION = _struct("revision_id:s version_id:s digest:s observed_at:t")
MENTION = _struct("id:s evidence_id:s run_id:s surface:s normalized_name:s proposed_email:s email_evidence_id:s recorded_at:t")
PROPOSAL = _struct("proposal_id:s mention_id:s run_id:s version_id:s recorded_at:t")
PROPOSAL_EVIDENCE = _struct("proposal_id:s position:i evidence_id:s")
CANDIDATE = _struct("proposal_id:s entity_id:s rank:i confidence:d reason:s source:s")
ALIAS = _struct("decision_id:s kind:s value:s")
RUN = _struct("run_id:s version_id:s derivation:s outcome:s write_digest:s recorded_at:t")
#: A run's attempts, only appended: who claimed it until when, and how the attempt ended.
ATTEMPT = _struct("run_id:s number:i event:s owner:s at:t lease_until:t fault:s")
#: The directory: profiles seen, lookups made, and which entity a provider's subject was linked to by which decision.
PROFILE = _struct("provider:s subject_id:s display_name:s emails:a observed_at:t")
LOOKUP = _struct("lookup_id:s mention_id:s email:s outcome:s attempted_at:t retry_after:t")
DIRECTORY_LINK = _struct("provider:s subject_id:s entity_id:s decision_id:s proposal_id:s recorded_at:t")



def sealed(kind: T.StructType, name: str = "digest") -> T.StructType:
    """A layout with the digest of each row's content, made when it is stored and held against it when it is read."""
    return T.StructType([*kind.fields, T.StructField(name, T.StringType())])


#: Tables of a store with the columns that are each one's key.
TABLES = {
    "observations": (sealed(OBSERVATION), ["obs_id"]), "links": (EVIDENCE_LINK, ["obs_id", "evidence_id", "role"]), "decisions": (sealed(STORED_DECISION), ["id"]),
    "admissions": (sealed(STORED_ADMISSION), ["id"]), "entities": (ENTITY, ["id"]), "spans": (SPAN, ["evidence_id"]), "sections": (sealed(SECTION, "leaf"), ["version_id", "section_id"]),
    "versions": (VERSION, ["version_id"]), "sources": (SOURCE, ["source_id"]), "pointers": (POINTER, ["source_id", "seq"]), "revisions": (REVISION, ["revision_id"]),
    "mentions": (MENTION, ["id"]), "proposals": (PROPOSAL, ["proposal_id"]), "proposal_evidence": (PROPOSAL_EVIDENCE, ["proposal_id", "position"]),
    "candidates": (CANDIDATE, ["proposal_id", "entity_id"]), "aliases": (ALIAS, ["decision_id", "kind", "value"]), "runs": (RUN, ["run_id"]), "attempts": (ATTEMPT, ["run_id", "number", "event"]),
    "profiles": (PROFILE, ["provider", "subject_id", "observed_at"]), "lookups": (LOOKUP, ["lookup_id"]), "directory_links": (DIRECTORY_LINK, ["provider", "subject_id", "entity_id", "proposal_id", "recorded_at"]),
}

# The closed sets of the data model.
TERM_KINDS = ("absent", "text", "mention", "entity")
EXTENT_KINDS = ("unknown", "instant", "interval", "window")
STATUSES = ("observed", "inferred", "hypothesized", "validated_structurally", "validated_empirically", "rejected")
ROLES = ("supporting", "contradicting")
UNRESOLVED_REASONS = ("temporal-uncertainty", "hypothesized", "conflicting-values", "multiple-states-in-window", "counterevidence-only")
CHANGE_KINDS = ("added", "removed", "changed")
COVERAGE_CLASSES = ("predicate-filtered", "entity-filtered", "authority-excluded", "unresolved-mention", "retained")
ADMISSION_TARGETS = ("extraction_run", "mention", "observation", "identity_decision")
ADMISSION_OUTCOMES = ("admitted", "quarantined", "retired")
SIGNAL_CATEGORIES = ("delegation_autonomy", "scrutiny_correction", "endorsement_trust", "support_advocacy", "future_responsibility")
SIGNAL_DIRECTIONS = ("strengthening", "weakening", "mixed", "unclear")
TAB_ROLES = ("transcript", "notes", "other")

#: The one predicate of explicit causal claims.
CAUSES = "evidentia.causal/causes"

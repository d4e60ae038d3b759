"""The four questions, asked of one snapshot of tables, answered with provenance and gaps."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import timeaxis as ta
from evidentia.functions.order import CITATION, key_order
from evidentia.operators import authority, causal, checks, citations, gaps, seals, state, trajectory
from evidentia.plans import render
from evidentia.plans.lineage import cut, few, met
from evidentia.plans.request import CAUSAL, MAX_ROWS, POINT, TRAJECTORY, TREND, At, Request, ask, normalize
from evidentia.schema import EVIDENCE_LINK

#: Rows of contributions and citations that one envelope holds at most; lines() has no bound.
MAX_CITED = 100_000


class UnknownEntity(ValueError):
    """A requested entity is not known in the scope; no gap, an error."""


class OverLimit(ValueError):
    """More rows than the request or an envelope allows; nothing is cut off."""


@dataclass
class Result:
    """Frames of one answer; which are set depends on the intent.

    `citations` is the long form of provenance, a row for each contributing observation and link: with the label of
    the selection and the key for states, with key, instant and side for transitions, with cause and effect as key and
    value for links. A change's two sides are the states of its key under the two labels.
    """

    request: Request
    facts: DataFrame | None = None
    unresolved: DataFrame | None = None
    changes: DataFrame | None = None
    transitions: DataFrame | None = None
    links: DataFrame | None = None
    citations: DataFrame | None = None
    moves: DataFrame | None = None
    gaps: DataFrame | None = None
    keys: DataFrame | None = field(default=None, repr=False)


def _lit(t):
    return F.lit(t).cast("timestamp_ntz")


@dataclass
class Read:
    """One coherent read: every part of the answer sees these rows."""

    rows: DataFrame
    cover: DataFrame
    requested: DataFrame
    links: DataFrame


class Engine:
    """tables: observations, links, decisions, admissions, entities; spans, versions, sections and, if kept, sources make
    citations exact and are held against the cutoff; without them citations have ids and roles only.

    verify: the chains of the decisions that bear on the question and the answer itself are checked; of tables with
    digests (as a store has them) also the digests of these decisions, admissions and observations, and of every cited
    span that it quotes its section, and that section and version are what was stored. What contradicts itself raises
    Inconsistent.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], verify: bool = True):
        self.spark, self.t, self.verify = spark, tables, verify

    def _near(self, requested: DataFrame, ids: list[str], cutoff) -> DataFrame:
        """Observations that name a requested entity, or a mention that any decision ever gave to one; once each.

        The terms asked for are met in one pass for each end; only the rows that name one are shuffled while they are few().
        """
        known = authority.known_by(self.t["observations"], cutoff)
        given = self.t["decisions"].where(F.col("entity_id").isin(ids)).select(F.lit("mention").alias("kind"), F.col("mention_id").alias("ref"))
        terms = cut(requested.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("ref")).unionByName(given).distinct())
        near = []
        for end in ("subject", "object"):
            named = known.where(F.col(f"{end}_kind").isin("entity", "mention"))
            near.append(met(named, terms.select(F.col("kind").alias(f"{end}_kind"), F.col("ref").alias(f"{end}_ref")), [f"{end}_kind", f"{end}_ref"]))
        return cut(state.dedupe_observations(near[0].unionByName(near[1])))

    def read(self, r: Request) -> Read:
        """The rows in the request's scope, classified; valid time is not looked at yet."""
        t, cutoff = self.t, r.known_as_of
        ids = list(r.entity_ids)
        requested = self.spark.createDataFrame([(i,) for i in ids], "entity_id string")
        known = authority.entity_authority(requested, t["entities"].where(F.col("id").isin(ids)), cutoff)
        missing = [x["entity_id"] for x in known.where("not known").collect()]  # at most as many as were asked for
        if missing:
            raise UnknownEntity(", ".join(sorted(missing)))
        rows = self._near(requested, ids, cutoff)
        ends = F.explode(F.array(*(F.struct(F.col(f"{e}_kind").alias("kind"), F.col(f"{e}_ref").alias("ref")) for e in ("subject", "object"))))
        terms = rows.select(ends.alias("e")).select("e.*").distinct()
        mentions = terms.where("kind = 'mention'").select(F.col("ref").alias("mention_id"))
        decisions = cut(met(t["decisions"], mentions, ["mention_id"]))
        targets = rows.select(F.lit("observation").alias("target_kind"), F.col("obs_id").alias("target_id"))
        targets = targets.unionByName(mentions.select(F.lit("mention").alias("target_kind"), F.col("mention_id").alias("target_id")))
        targets = targets.unionByName(decisions.select(F.lit("identity_decision").alias("target_kind"), F.col("id").alias("target_id")))
        admissions = cut(met(t["admissions"], targets, ["target_kind", "target_id"]))
        named = terms.where("kind = 'entity'").select(F.col("ref").alias("id")).unionByName(decisions.where("entity_id is not null").select(F.col("entity_id").alias("id")))
        entities = cut(met(t["entities"], named, ["id"]))
        links = cut(met(t["links"].select(*EVIDENCE_LINK.names), rows, ["obs_id"]))
        if self.verify:
            self._trusted(decisions, admissions, cutoff)
        resolved = authority.resolve_terms(rows, authority.resolved_mentions(decisions, admissions, entities, cutoff), entities, cutoff, F.broadcast(requested))
        told = self._told(links)
        seen = authority.evidence_visible(links, told.get("spans"), told.get("versions"), told.get("sources"), cutoff)
        q = cut(authority.qualify(resolved, authority.admitted(admissions, "observation", cutoff), seen, len(ids), list(r.predicates) or None, r.match))
        kept = q.where("class = 'retained'")
        # a mention that resolves is the entity: the resolved term is the key, the mention its grounding
        for end in ("subject", "object"):
            kept = kept.withColumn(f"{end}_grounding", F.when(F.col(f"{end}_kind") == "mention", F.col(f"{end}_ref")))
            kept = kept.withColumn(f"{end}_ref", F.coalesce(f"{end}_entity", f"{end}_ref")).withColumn(f"{end}_kind", F.when(F.col(f"{end}_entity").isNotNull(), "entity").otherwise(F.col(f"{end}_kind")))
        support = links.where("role = 'supporting'").select("obs_id").distinct().withColumn("supported", F.lit(True))
        kept = cut(kept.join(support, "obs_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False))))
        cover = cut(authority.coverage(q))
        own = links.join(kept.select("obs_id"), "obs_id", "left_semi")
        if told:
            told["sections"] = self._sections(told["spans"].join(own, "evidence_id", "left_semi"))
        cited = cut(self._cited(own, told, cutoff))
        if self.verify:
            found = [checks.qualification_faults(q, cover, requested), checks.candidate_faults(kept, rows)]
            if "digest" in rows.columns:
                found.append(checks._fault(seals.observation_faults(rows, links), "observation", F.col("obs_id"), F.col("fault")))
            if told and "leaf" in t["sections"].columns:
                found.append(checks._fault(citations.proof_faults(own, told["spans"], told["versions"], told["sections"]), "evidence", F.col("id"), F.col("fault")))
            if told:
                found.append(checks.faults(*(checks._fault(f, "evidence", F.coalesce("obs_id", "evidence_id"), F.col("fault")) for f in (citations.link_faults(own, cited),))))
            checks.require(*found)
        return Read(kept, cover, requested, cited)

    def _trusted(self, decisions: DataFrame, admissions: DataFrame, cutoff) -> None:
        target = admissions.withColumn("target", F.struct("target_kind", "target_id"))
        found = [checks.chain_faults(authority.chain_violations(decisions, "proposal_id", cutoff), "decision"), checks.chain_faults(authority.chain_violations(target, "target", cutoff), "admission")]
        for df, columns, name in ((decisions, authority.RESOLUTION_DIGEST, "decision"), (admissions, authority.ADMISSION_DIGEST, "admission")):
            if "digest" in df.columns:
                found.append(checks.chain_faults(authority.digest_violations(df, columns, cutoff), name))
        checks.require(*found)

    def _told(self, links: DataFrame) -> dict[str, DataFrame]:
        """The spans that the links cite, their versions and sources; none if spans are not kept. Each table is gone through
        once, for all that asks about it later."""
        t = self.t
        if "spans" not in t:
            return {}
        told = {"spans": cut(met(t["spans"], links, ["evidence_id"]))}
        told["versions"] = cut(met(t["versions"], told["spans"], ["version_id"]))
        if "sources" in t:
            told["sources"] = cut(met(t["sources"], told["versions"], ["source_id"]))
        return told

    def _sections(self, spans: DataFrame) -> DataFrame:
        """All sections of the versions that the spans cite, contents only of those that a span cites."""
        rows = met(self.t["sections"], spans, ["version_id"])
        if "content" in rows.columns:
            pair = ["version_id", "section_id"]
            rows = rows.join(few(spans.select(*pair).distinct().withColumn("_cited", F.lit(True))), pair, "left")
            rows = rows.withColumn("content", F.when(F.col("_cited"), F.col("content"))).select(*self.t["sections"].columns)
        return cut(rows)

    def _cited(self, links: DataFrame, told: dict[str, DataFrame], cutoff) -> DataFrame:
        """The links with what they cite."""
        if told:
            return citations.citations(links, told["spans"], told["versions"], told["sections"], told.get("sources"), cutoff)
        kinds = {"section_order": "long", "start_byte": "long", "end_byte": "long", "section_path": "array<string>"}
        return links.select("obs_id", *(F.col(c) if c in ("evidence_id", "role") else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in CITATION))

    def query(self, request: Request) -> Result:
        r = normalize(request)
        read = self.read(r)
        out = {POINT: self._state, TREND: self._state, TRAJECTORY: self._trajectory, CAUSAL: self._causal}[r.intent](r, read)
        if self.verify:
            checks.require(*self._result_faults(out))
        return out

    @staticmethod
    def _result_faults(x: Result) -> list[DataFrame]:
        r = x.request
        labels = [s.label for s in r.selections]
        found = [checks.gap_faults(x.gaps, r.entity_ids, labels, r.predicates, r.intent == CAUSAL)]
        if x.keys is not None:
            values = x.unresolved.select("label", *state.KEY, *state.VALUE).unionByName(x.facts.select("label", *state.KEY, *state.VALUE) if x.facts is not None else x.unresolved.select("label", *state.KEY, *state.VALUE).where("false"))
            keys = x.keys if x.facts is not None else x.keys.where("outcome <> 'resolved'")
            found += [checks.summary_faults(keys, values, ["label"]), checks.fact_faults(x.citations, ["label"])]
        if x.changes is not None:
            found.append(checks.trend_faults(x.keys, x.changes, *labels))
        if x.transitions is not None:
            found.append(checks.transition_faults(x.transitions, r.selections[0].start, r.selections[0].end))
        return found

    @staticmethod
    def _rules(s):
        if isinstance(s, At):
            return ta.at_point(_lit(s.instant)), ta.outside_point(_lit(s.instant))
        return ta.in_window(_lit(s.start), _lit(s.end)), ta.outside_window(_lit(s.start), _lit(s.end))

    def _states(self, r: Request, read: Read):
        """(keys, values, told) of all selections, aggregated in one pass."""
        rows, eligible, uncertain = state.labelled(read.rows, {s.label: self._rules(s)[0] for s in r.selections})
        classified, of_values, keys = state.aggregate(rows, eligible, uncertain, sel=["label"], at_point=r.intent == POINT)
        keys, of_values = cut(keys), cut(of_values)
        return keys, of_values, cut(state.provenance(classified, keys, read.links, ["label"], list(render.CONTRIBUTION)))

    def _gaps(self, r: Request, read: Read, told: DataFrame) -> DataFrame:
        outside = self._rules(r.selections[0])[1] if r.intent != TREND else None  # a trend keeps all coverage
        found = gaps.coverage_gaps(read.cover, outside)
        for s in r.selections:
            found = found.unionByName(gaps.valid_time_gaps(read.rows, self._rules(s)[1], s.label))
        found = cut(found)
        return gaps.in_order(cut(found.unionByName(gaps.no_evidence(read.requested, self._material(told), found))))

    def _state(self, r: Request, read: Read) -> Result:
        keys, of_values, told = self._states(r, read)
        return Result(
            r, facts=keys.where("outcome = 'resolved'").select("label", *state.KEY, *state.VALUE), unresolved=self._unresolved(keys, of_values), citations=told,
            changes=cut(state.compare(keys, *(s.label for s in r.selections))) if r.intent == TREND else None, gaps=self._gaps(r, read, told), keys=keys,
        )

    def _trajectory(self, r: Request, read: Read) -> Result:
        s = r.selections[0]
        moves = cut(self._bounded(cut(trajectory.transitions(read.rows, s.start, s.end)), r.limit))
        sides = trajectory.material(read.rows, moves, s.start, s.end)
        shown = read.rows.select("obs_id", *(c for c in render.CONTRIBUTION if c != "recorded_at"))
        sides = cut(sides.join(shown, "obs_id").join(read.links, "obs_id", "left"))
        ordered = moves.join(trajectory.ties(sides), [*state.KEY, "instant"], "left").orderBy("instant", F.col("first_recorded").asc_nulls_last(), "first_obs", *key_order(), "change")
        keys, of_values, told = self._states(r, read)
        open_ = told.where("outcome <> 'resolved'")
        return Result(r, transitions=ordered, moves=sides, unresolved=self._unresolved(keys, of_values), citations=open_, gaps=self._gaps(r, read, told), keys=keys)

    def _causal(self, r: Request, read: Read) -> Result:
        s = r.selections[0]
        links = self._bounded(cut(causal.causal_links(read.rows, read.links, s.start, s.end)), r.limit)
        null = F.lit(None).cast("string")
        none = self.spark.range(1).select(F.lit("no-causal-evidence").alias("kind"), F.lit("").alias("entity_id"), F.lit(s.label).alias("label"), null.alias("predicate"))
        none = none.join(links.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti")
        eligible, _ = ta.in_window(_lit(s.start), _lit(s.end))
        told = read.rows.where(eligible).join(read.links, "obs_id", "left").select(*state.KEY, *state.VALUE, "obs_id", *render.CONTRIBUTION, *CITATION)
        return Result(r, links=causal.in_order(links), citations=cut(told), gaps=gaps.in_order(gaps.coverage_gaps(read.cover).unionByName(none)))

    @staticmethod
    def _bounded(df: DataFrame, limit: int) -> DataFrame:
        if df.limit(limit + 1).count() > limit:
            raise OverLimit(f"more than {limit} rows")
        return df

    @staticmethod
    def _unresolved(keys: DataFrame, of_values: DataFrame) -> DataFrame:
        open_ = keys.where("outcome <> 'resolved'").select("label", *state.KEY, F.col("outcome").alias("reason"))
        return of_values.join(open_, ["label", *state.KEY]).select("label", *state.KEY, "reason", *state.VALUE, "n_rows")

    @staticmethod
    def _material(told: DataFrame) -> DataFrame:
        """Entities that facts or unresolved keys name."""
        subject = told.where("subject_kind = 'entity'").select(F.col("subject_ref").alias("entity_id"))
        return subject.unionByName(told.where("object_kind = 'entity'").select(F.col("object_ref").alias("entity_id"))).distinct()

    # ---- answers as rows of JSON ------------------------------------------------------------------------

    def members(self, result: Result) -> dict[str, DataFrame]:
        """Each member of the answer as rows (order, content): facts and candidates nested with what they cite."""
        r, of_key, key = result.request, render.place_of_key(), render.key_struct().alias("key")
        out: dict[str, DataFrame] = {}
        if result.keys is not None:
            values = render.cited_values(result.citations, ["label", "outcome"])
            open_ = render.candidates_of(values.where("outcome <> 'resolved'"), ["label", "outcome"])
            unresolved = render.member(open_, [F.col("label"), *of_key, F.col("outcome")], F.struct("label", key, F.col("outcome").alias("reason"), "candidates"))
            facts = values.where("outcome = 'resolved'").select("label", *state.KEY, *state.VALUE, "fact")
            if r.intent != TRAJECTORY:
                out["facts"] = render.member(facts, [F.col("label"), *of_key], F.struct("label", F.col("fact.*")))
            out["unresolved"] = unresolved
        if result.changes is not None:
            side = lambda s, tag: facts.where(F.col("label") == s.label).select(*state.KEY, F.col("fact").alias(tag))
            both = result.changes.where("change <> 'unresolved'").join(side(r.selections[0], "before"), state.KEY, "left").join(side(r.selections[1], "after"), state.KEY, "left")
            out["changes"] = render.member(both, of_key, F.struct(F.col("change").alias("kind"), key, "before", "after"))
            out["unresolved_keys"] = render.member(result.changes.where("change = 'unresolved'"), of_key, key)
        if result.transitions is not None:
            at = [*state.KEY, "instant"]
            values = render.cited_values(result.moves, ["instant", "side", "outcome"])
            rows = result.transitions
            for name in ("before", "after"):
                rows = rows.join(values.where(f"side = '{name}' and outcome = 'resolved'").select(*at, F.col("fact").alias(name)), at, "left")
            open_ = render.candidates_of(values.where("outcome <> 'resolved'"), ["instant", "side", "outcome"])
            # of one key: in order of the reason, and of one reason the side before first
            open_ = open_.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(F.col("outcome").alias("reason"), (F.col("side") == "after").alias("later"), "side", "candidates"))).alias("unresolved"))
            open_ = open_.withColumn("unresolved", F.transform("unresolved", lambda x: F.struct(x["side"].alias("side"), x["reason"].alias("reason"), x["candidates"].alias("candidates"))))
            rows = rows.join(open_, at, "left")
            order = [F.col("instant"), F.col("first_recorded").isNull(), F.col("first_recorded"), F.col("first_obs"), *of_key, F.col("change")]
            content = F.struct(F.col("change").alias("kind"), key, ta.rfc3339("instant").alias("instant"), "before", "after", F.coalesce("unresolved", F.array()).alias("unresolved"))
            out = {"transitions": render.member(rows, order, content)} | out
        if result.links is not None:
            values = render.cited_values(result.citations, [])
            names = {"cause_kind": "subject_kind", "cause_ref": "subject_ref", "effect_kind": "object_kind", "effect_ref": "object_ref"}
            rows = result.links.select("first_bound", "first_recorded", "first_obs", *(F.col(a).alias(b) for a, b in names.items())).join(values, list(names.values()))
            order = [F.col("first_bound").isNull(), F.col("first_bound"), F.col("first_recorded"), F.col("first_obs"), *render._ranked("subject_kind", "subject_ref"), *render._ranked("object_kind", "object_ref")]
            term = lambda kind, ref, name: F.struct(F.col(kind).alias("kind"), F.col(ref).alias("ref")).alias(name)
            out["links"] = render.member(rows, order, F.struct(term("subject_kind", "subject_ref", "cause"), term("object_kind", "object_ref", "effect"), "contributions", "supporting", "contradicting"))
        label, predicate = F.col("label"), F.col("predicate")
        out["gaps"] = render.member(result.gaps, [F.col("entity_id"), F.col("kind"), F.coalesce(label, F.lit("")), F.coalesce(predicate, F.lit(""))], F.struct("kind", "entity_id", "label", "predicate"))
        return out

    def lines(self, result: Result) -> DataFrame:
        """(member, json): the answer's rows one by one, whatever their number."""
        return render.lines(self.members(result))

    def envelope(self, result: Result) -> DataFrame:
        """One JSON text: the request, exactly one payload member, gaps; arrays are never null and fully ordered.

        An answer of more than MAX_ROWS rows of a member or MAX_CITED contributions is refused (OverLimit), not cut:
        lines() gives it row by row.
        """
        members = self.members(result)
        for told in (result.citations, result.moves):
            if told is not None:
                self._bounded(told, MAX_CITED)
        for df in members.values():
            self._bounded(df, MAX_ROWS)
        r = result.request
        name = {POINT: "point", TREND: "trend", TRAJECTORY: "trajectory", CAUSAL: "causal"}[r.intent]
        scope = ta.rfc3339(_lit(r.known_as_of)) if r.known_as_of else F.lit("current")
        payload = F.struct(*(k for k in members if k != "gaps"))
        texts = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
        selections = F.array(*(
            F.struct(F.lit(s.label).alias("label"), *((ta.rfc3339(_lit(s.instant)).alias("start"), F.lit(None).cast("string").alias("end")) if isinstance(s, At) else (ta.rfc3339(_lit(s.start)).alias("start"), ta.rfc3339(_lit(s.end)).alias("end"))))
            for s in r.selections
        ))
        asked = F.struct(
            F.lit(r.intent).alias("intent"), texts(r.entity_ids).alias("entity_ids"), F.lit(r.match).alias("entity_match"), texts(r.predicates).alias("predicates"), selections.alias("selections"),
            scope.alias("knowledge_scope"), F.lit(r.limit).alias("limit"),
        )
        out = render.gathered(members)
        return out.select(F.to_json(F.struct(F.lit("evidentia.temporal/2").alias("version"), asked.alias("request"), payload.alias(name), "gaps"), {"ignoreNullFields": "false"}).alias("json"))

    def text(self, result: Result) -> str:
        """The same rows as lines of text, at most MAX_ROWS of a kind."""
        lines = [f"intent: {result.request.intent}", f"knowledge scope: {result.request.known_as_of or 'current'}"]
        for name in ("facts", "unresolved", "changes", "transitions", "links", "gaps"):
            df = getattr(result, name)
            if df is not None:
                found = [" ".join(f"{k}={v}" for k, v in r.asDict().items() if v is not None) for r in self._bounded(df, MAX_ROWS).collect()]
                lines += [f"{name}: {len(found)}", *(f"  {x}" for x in (found if name in ("transitions", "links", "gaps") else sorted(found)))]
        return "\n".join(lines)


def answer(engine: Engine, question: str, planner, entity_ids: tuple[str, ...]) -> Result:
    """A question in words: the planner proposes a request without seeing the ids, the engine answers it, and the answer
    must be the answer to that request."""
    request = ask(question, planner, entity_ids)
    result = engine.query(request)
    if not same_request(result, request):
        raise checks.Inconsistent("the answer is to another request")
    return result


def same_request(result: Result, request: Request) -> bool:
    """Whether an answer is the answer to a request, selections, scope, match and limits included."""
    return result.request == normalize(request)

"""A folder of pages and documents as JSON, as a client of the paged source."""

import json
import os


class Folder:
    def __init__(self, options):
        self.root = options["root"]

    def page(self, collection, token):
        with open(f"{self.root}/{collection}/{token or 'first'}.json", encoding="utf-8") as f:
            return json.load(f)

    def document(self, doc_id):
        with open(f"{self.root}/docs/{doc_id}.json", encoding="utf-8") as f:
            return json.load(f)


def put(root, collection, token, ids, then=None):
    os.makedirs(f"{root}/{collection}", exist_ok=True)
    documents = [{"doc_id": i, "provider": "desk", "title": f"[2041-05-01] Talk {i}", "locator": f"talks/{i}", "provider_version": "1", "modified_at": "2041-05-02T10:00:00"} for i in ids]
    with open(f"{root}/{collection}/{token or 'first'}.json", "w", encoding="utf-8") as f:
        json.dump({"documents": documents, "next": then}, f)


def put_document(root, doc_id, provider="desk", tabs=()):
    os.makedirs(f"{root}/docs", exist_ok=True)
    with open(f"{root}/docs/{doc_id}.json", "w", encoding="utf-8") as f:
        json.dump({"title": "", "locator": f"read/{doc_id}", "provider": provider, "tabs": list(tabs)}, f)

"""A small source of our own: nine verses, three books, in the layout that repositories have."""

import copy
import hashlib
import json
from pathlib import Path

META = {"translation": "Small Test", "abbreviation": "tiny", "lang": "en", "language": "English", "direction": "LTR", "encoding": "UTF-8"}


def book(nr, name, verses):
    return {"nr": nr, "name": name, "chapters": [{"chapter": 1, "name": f"{name} 1", "verses": [{"chapter": 1, "verse": i, "name": f"{name} 1:{i}", "text": t} for i, t in enumerate(verses, 1)]}]}


TINY = META | {
    "description": "Nine verses",
    "distribution_license": "own work",
    "books": [
        book(1, "Genesis", ["In the beginning all was calm.", "The river ran, and the hills stood.", "Faith hope: love greater than love.", "A café by the road."]),
        book(40, "Matthew", ["Nothing of note.", "Faith is near to hope, they say.", "Faith came first and, after a very long while, then hope.", "The Word and the word."]),
        book(67, "1 Wisdom", ["Wisdom built a house."]),
    ],
}
ALIASES = {"kjv": {"1": ["Genesis", "Gen", "Ge."], "40": ["Matthew", "Mt"], "43": ["John"], "62": ["1 John", "First John"], "67": ["1 Wisdom"]}, "cns": {"1": ["創世記", "创记"], "2": ["Ge."]}, "fra": {"1": ["Génèse"], "43": ["Jean"], "62": ["Jean"]}}


def index_of(doc):
    return {str(b["nr"]): {k: doc[k] for k in META} | {"nr": b["nr"], "name": b["name"]} for b in doc["books"]}


def chapters_of(doc):
    """(path, chapter file) of all chapters, with the open fields of the chapter."""
    for b in doc["books"]:
        for c in b["chapters"]:
            yield f"{doc['abbreviation']}/{b['nr']}/{c['chapter']}", {k: doc[k] for k in META} | {"book_nr": b["nr"], "book_name": b["name"]} | c


def put_chapters(root, doc=None, sha=True):
    for path, c in chapters_of(doc or TINY):
        at = Path(root) / "v2" / f"{path}.json"
        at.parent.mkdir(parents=True, exist_ok=True)
        raw = json.dumps(c, ensure_ascii=False).encode()
        at.write_bytes(raw)
        if sha:
            at.with_suffix(".sha").write_text(sha if isinstance(sha, str) else hashlib.sha1(raw).hexdigest())


def put(root, doc=None, sha=True, index=None, **changes):
    doc = copy.deepcopy(doc or TINY) | changes
    at = Path(root) / "v2"
    (at / doc["abbreviation"]).mkdir(parents=True, exist_ok=True)
    raw = json.dumps(doc, ensure_ascii=False).encode()
    (at / f"{doc['abbreviation']}.json").write_bytes(raw)
    (at / doc["abbreviation"] / "books.json").write_text(json.dumps(index or index_of(doc)), "utf-8")
    if all(b.get("chapters") for b in doc["books"]):
        put_chapters(root, doc)
    if sha:
        (at / f"{doc['abbreviation']}.sha").write_text((sha if isinstance(sha, str) else hashlib.sha1(raw).hexdigest()) + "\n")
    return doc


def put_aliases(root):
    Path(root).mkdir(parents=True, exist_ok=True)
    for code, names in ALIASES.items():
        (Path(root) / f"{code}.json").write_text(json.dumps(names, ensure_ascii=False), "utf-8")
    return str(root)


def alias_rows():
    return [(c, n, int(b)) for c, m in ALIASES.items() for b, names in m.items() for n in names]

"""Results grouped by chapter, as tables and as documents."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pericope.errors import SearchLimitError


def group_key(abbreviation: Column, book: Column, chapter: Column) -> Column:
    return F.concat_ws("_", abbreviation, book.cast("string"), chapter.cast("string"))


def grouped(hits: DataFrame, rank: list[Column], reference: str = "reference", text: str = "text") -> DataFrame:
    """(key, first, refs, verses): hits by chapter, in the order of rank; first is the group's first rank within its chapter's order."""
    ranked = hits.withColumn("at", F.struct(*rank))
    key = group_key(F.col("abbreviation"), F.col("book_nr"), F.col("chapter"))
    g = ranked.groupBy(key.alias("key")).agg(F.array_sort(F.collect_list(F.struct("at", F.col(reference).alias("ref"), F.col("verse").alias("verse"), F.col(text).alias("text")))).alias("v"))
    return g.select("key", F.col("v")[0]["at"].alias("first"), F.array_distinct(F.transform("v", lambda x: x["ref"])).alias("refs"), F.transform("v", lambda x: F.struct(x["verse"].alias("verse"), x["text"].alias("text"))).alias("verses"))


def first_by_verse(rows: DataFrame, order: list[str]) -> DataFrame:
    """Of rows for one verse, the first in order."""
    return rows.withColumn("n", F.row_number().over(W.partitionBy("book_nr", "chapter", "verse").orderBy(*order))).where("n = 1").drop("n")


def json_bytes(x: Any) -> int:
    return len(json.dumps(x, ensure_ascii=False, separators=(",", ":")).encode())


def verse_document(row: Any) -> dict:
    """A verse as its source has it, open fields included."""
    return {"chapter": row["chapter"], "verse": row["verse"], "name": row["reference"], "text": row["text"], **json.loads(row["extra_json"] or "{}")}


def search_document(rows: list, q: Any, metadata: dict, chapter_fields: dict, abbreviation: str, sha: str, checked_at: float, stale: bool, total: int, work: int, deadline: float, max_bytes: int) -> dict:
    """The answer to a search from one page of hits, at most the page limit many. Stops as soon as it would be over max_bytes."""
    spec = q.spec
    size = json_bytes(metadata)
    results: dict[str, dict] = {}
    matches: list[dict] = []
    for r in rows:
        key = f"{abbreviation}_{r['book_nr']}_{r['chapter']}"
        if key not in results:
            results[key] = dict(chapter_fields, book_nr=r["book_nr"], book_name=r["book_name"], chapter=r["chapter"], name=r["chapter_name"], ref=[], verses=[])
            size += json_bytes(results[key])
        verse = verse_document(r)
        match = {"reference": r["reference"], "book_nr": r["book_nr"], "chapter": r["chapter"], "verse": r["verse"], "score": r["score"], "occurrences": r["occurrences"], "terms": list(r["terms"])}
        size += json_bytes(verse) + json_bytes(match)
        if size > max_bytes:
            raise SearchLimitError(f"The answer would be over {max_bytes} bytes.")
        results[key]["ref"].append(r["reference"])
        results[key]["verses"].append(verse)
        matches.append(match)
    query = {
        "text": q.text, "criteria": spec.to_dict(), "translation": dict(metadata), "sha": sha, "total": total, "offset": spec.offset, "limit": spec.limit, "returned": len(rows),
        "has_more": spec.offset + len(rows) < total, "cache": {"checked_at": checked_at, "stale": stale}, "cost": {"work_units": work, "deadline_seconds": float(deadline), "expensive": spec.expensive},
    }
    out = {"query": query, "results": results, "matches": matches}
    if json_bytes(out) > max_bytes:
        raise SearchLimitError(f"The answer has {json_bytes(out)} bytes, {max_bytes} are allowed.")
    return out

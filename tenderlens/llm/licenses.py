"""Operator 1: licence scan by sparse TF-IDF cosine, then inheritance from the nearest ancestor directory.

Every file, each of its paragraphs (runs of lines with a term) and each of its lines are candidates.
They are compared with licence templates as sparse TF-IDF rows (term, weight).  Document
frequencies count the files that hold a term, over all files.

Candidates that cannot reach ``threshold`` are left out by two bounds, both exact.  A template's
*leading* terms are its heaviest, so many that its other terms have a norm below the threshold: a
candidate without one stays below.  And no weight of a term is less than its count, so the
templates' own weights and the counts of all other terms bound a candidate's cosine from above.
Those left are few; they are weighed over their whole vocabulary and multiplied exactly.  A
candidate's best template counts from ``threshold`` on, and a file's licence is that of its best
candidate.

A file is a licence file if ``is_license`` says so or, where that is null, if its whole text
reaches the threshold.  A file without a licence of its own takes that of the licence file in its
nearest ancestor directory, found by joining the distinct directories with their ancestors by
path.  A directory's licence file is the one of greatest score, then least path.

Null and empty texts have no licence of their own and may inherit; null paths neither give nor
inherit; ties go to the first template; repeated rows give equal rows; very long texts are compared
whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, ship, small
from .templates import TEMPLATES

ship(__name__)

THRESHOLD, SALTS = 0.6, 16
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
FIND = re.compile(TERM)
#: The same for Java, whose matcher else recurses once per part of a chained word: parts are disjoint, so nothing is ever given back.
TERM_NOW = r"[a-z0-9]++(?:[.-][a-z0-9]++)*+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_NOW), F.lit(0))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder and all above it, the root as the empty string."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def counted(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)."""
    return rows.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def weighed(tf: DataFrame, frequency: DataFrame, files: int, key: str) -> DataFrame:
    """(key, term, weight, idf): TF-IDF rows of norm 1."""
    idf = F.log((F.lit(1.0) + files) / (1 + F.coalesce("df", F.lit(0)))) + 1
    raw = tf.join(frequency, "term", "left").select(key, "term", (F.col("tf") * idf).alias("weight"), idf.alias("idf"))
    norms = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return raw.join(norms, key).select(key, "term", (F.col("weight") / F.col("norm")).alias("weight"), "idf")


class Bounds:
    """Leading terms of the templates, and an upper bound of a candidate's best cosine from the templates' vocabulary alone."""

    def __init__(self, weights: list[tuple[int, str, float, float]], threshold: float):
        """``weights``: (template, term, weight, idf)."""
        self.threshold = threshold - 1e-9
        size = 1 + max((t for t, *_ in weights), default=0)
        self.idf = {term: idf for _, term, _, idf in weights}
        self.rows = {term: np.zeros(size) for term in self.idf}
        for t, term, w, _ in weights:
            self.rows[term][t] = w
        self.lead: set[str] = set()
        for t in range(size):
            light = 0.0
            for w, term in sorted((w, term) for k, term, w, _ in weights if k == t):
                light += w * w
                if light >= self.threshold**2:
                    self.lead.add(term)

    def reached(self, tf: Counter[str]) -> bool:
        dot, square = 0.0, 0.0
        for term, n in tf.items():
            idf = self.idf.get(term)
            if idf is None:
                square += n * n
            else:
                dot = dot + self.rows[term] * (n * idf)
                square += (n * idf) ** 2
        return bool(np.max(dot) >= self.threshold * square**0.5)


def candidates(bounds: Bounds):
    """(row, text) to (row, whole, candidate): the parts of each text that may reach the threshold."""

    def parts(text: str) -> Iterator[tuple[bool, str]]:
        lead, seen = bounds.lead, set()
        lines = text.split("\n")
        found = [FIND.findall(line.lower()) for line in lines]
        total, run, some = Counter(), [], False
        for line, ts in [*zip(lines, found, strict=True), ("", [])]:
            if ts:
                run.append((line, ts))
                continue
            led = [(x, y) for x, y in run if not lead.isdisjoint(y)]
            some = some or bool(led)
            own = Counter(t for _, y in run for t in y)
            total.update(own)
            for x, y in led:
                if x not in seen and bounds.reached(Counter(y)):
                    seen.add(x)
                    yield False, x
            if led and len(run) > 1 and bounds.reached(own):
                yield False, "\n".join(x for x, _ in run)
            run = []
        if some and bounds.reached(total):
            yield True, text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *p) for i, t in enumerate(batch.column("text")) for p in parts(t.as_py() or "")]
            at = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file_id").take(at), batch.column("path").take(at), pa.array([w for _, w, _ in found], pa.bool_()), pa.array([c for *_, c in found], pa.string())], ["file_id", "path", "whole", "candidate"])

    return run


def inherited(rows: DataFrame, given: DataFrame) -> DataFrame:
    """(folder, near): the licence of the nearest directory above each folder that holds a licence file.

    High directories stand above very many folders: their rows are spread over SALTS keys.
    """
    folders = rows.select("folder").filter("folder is not null").distinct()
    above = folders.select("folder", F.posexplode(F.reverse(ancestors(F.col("folder")))).alias("distance", "above"), F.pmod(F.xxhash64("folder"), F.lit(SALTS)).alias("salt"))
    spread = given.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    near = F.min_by(F.struct("passed", "above", "distance"), F.col("distance"))
    return above.join(small(durable(spread)), ["above", "salt"]).groupBy("folder").agg(near.alias("near"))


def license_scan(files: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> DataFrame:
    """``files`` (file_id, path, text, is_license) to one row per row: own and effective licence.

    Columns: file_id, path, own_license, own_score, license, origin (``own``, ``inherited`` or
    null), inherited_from (the licence file's directory) and distance (directories up).
    """
    spark = files.sparkSession
    per_file = files.select(F.explode(F.array_distinct(terms(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    frequency = durable(per_file.groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    number = files.count()
    fixed = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, name string, text string")
    known = durable(weighed(counted(fixed, "template", "text"), frequency, number, "template"))
    bounds = Bounds([tuple(r) for r in known.select("template", "term", "weight", "idf").collect()], threshold)  # the templates' terms

    kind = files.schema["file_id"].dataType.simpleString()
    found = files.select("file_id", "path", "text").mapInArrow(candidates(bounds), f"file_id {kind}, path string, whole boolean, candidate string")
    found = durable(found.withColumn("named", F.unhex(F.md5("candidate"))))  # joins and groups know a candidate by its digest
    distinct = found.select("named", "candidate").dropDuplicates(["named"])
    weights = weighed(counted(distinct, "named", "candidate"), frequency, number, "named")
    cosine = weights.join(F.broadcast(known.select("template", "term", F.col("weight").alias("fixed"))), "term").groupBy("named", "template").agg(F.sum(F.col("weight") * F.col("fixed")).alias("score"))
    best = cosine.groupBy("named").agg(F.max_by(F.struct("template", "score"), F.struct(F.round("score", 9), -F.col("template"))).alias("b")).filter(F.col("b.score") >= threshold - 1e-9)
    best = best.join(F.broadcast(fixed.select(F.col("template").alias("t"), "name")), F.col("b.template") == F.col("t")).select("named", "name", F.col("b.score").alias("score"), "t")

    # distinct notices are few beside their copies: while they are, they are broadcast, so that no common notice meets in a task
    hits = found.drop("candidate").join(small(durable(best)), "named")
    top = F.max_by(F.struct("name", "score"), F.struct(F.round("score", 9), -F.col("t")))
    own = hits.groupBy(F.col("file_id").alias("_f"), F.col("path").alias("_p")).agg(top.alias("h"), F.max("whole").alias("_whole"))
    own = own.select("_f", "_p", "_whole", F.col("h.name").alias("own_license"), F.round("h.score", 6).alias("own_score"))
    rows = files.select("file_id", "path", "is_license", directory(F.col("path")).alias("folder"))
    same = F.col("file_id").eqNullSafe(F.col("_f")) & F.col("path").eqNullSafe(F.col("_p"))
    rows = durable(rows.join(small(durable(own)), same, "left").drop("_f", "_p"))
    gives = F.coalesce("is_license", "_whole", F.lit(False)) & F.col("own_license").isNotNull() & F.col("folder").isNotNull()
    given = rows.filter(gives).groupBy(F.col("folder").alias("above")).agg(F.min_by("own_license", F.struct(-F.col("own_score"), F.col("path"))).alias("passed"))
    out = rows.join(small(durable(inherited(rows, given))), "folder", "left")
    inherits = F.col("own_license").isNull() & F.col("near").isNotNull()
    return out.select(
        "file_id", "path", "own_license", "own_score", F.coalesce("own_license", "near.passed").alias("license"),
        F.when(F.col("own_license").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("near.above")).alias("inherited_from"), F.when(inherits, F.col("near.distance")).alias("distance"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``documents`` as a tree source/lang/1/234/567.txt: the id's digits in groups of three, so that small ids lie above great ones."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    groups = F.coalesce(F.replace(F.format_number("doc_id", 0), F.lit(","), F.lit("/")), F.lit("none"))
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", part("source"), part("lang"), F.concat(groups, F.lit(".txt"))).alias("path"), "text", F.lit(None).cast("boolean").alias("is_license"))

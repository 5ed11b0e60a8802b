"""Problem 5: schemas that drift between shapes of one type.

Columns of successive shapes are profiled (kinds of value, a mergeable sketch of the values), fields that vanished are
matched to fields that are new by an optimal bipartite assignment over similarity of name, kind and values and over
declared renames. The report of changes takes the matches that an exact check finds declared; the others that score
LIKELY or more are listed apart, as renames that nobody declared. Both unify columns: in the one table of its type a
field has one name and one kind in every store and shape.

Defined results: rows with a wrong checksum or a null key don't count, a version counts once; payloads that are no
JSON array have no values, and come out whole in `rest`, as do those of unknown shapes; values beyond the shape's
fields come out in `rest` alone, missing ones are null; of rows of one shape that differ the one recorded last holds; a
shape without a predecessor has no change; ties between usual kinds go to the alphabetically first; a field whose
shapes differ in kind is float if they are int and float, else string; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.records import KIND_NAMES, intact_rows, kinds_of
from ..runtime import if_small, materialize, spread
from .orphans import shapes

#: Slots of the value sketch: the least hash of the values in each.
SLOTS = 16
#: Score of a declared rename: above any sum of similarities, so that the assignment never gives it up for a guess.
DECLARED = 100.0
#: Least similarity (of at most 3) at which an undeclared match counts as a rename.
LIKELY = 1.3
# The column type of each kind of value; lists and maps stay JSON text, a reference is its oid.
COLUMN_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string", "ref": "bigint", "list": "string", "map": "string"}


def kind_counts(objects: DataFrame) -> DataFrame:
    """(store_id, cid, pos, kind, n) over all versions; nulls have no kind."""
    rows = intact_rows(objects).where("payload is not null and cid is not null")
    signed = spread(rows.select("store_id", "oid", "tid", "cid", "payload")).select("store_id", "oid", "tid", "cid", kinds_of("payload").alias("sig")).dropDuplicates(["store_id", "oid", "tid", "cid"])
    groups = signed.groupBy("store_id", "cid", "sig").agg(F.count("*").alias("n")).where("sig is not null")
    letters = groups.select("store_id", "cid", "n", F.posexplode(F.split("sig", "")).alias("pos", "letter")).where("letter not in ('n', '')")
    named = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return letters.groupBy("store_id", "cid", "pos", F.element_at(named, F.col("letter")).alias("kind")).agg(F.sum("n").alias("n"))


def usual_kinds(counts: DataFrame) -> DataFrame:
    """(store_id, cid, pos, kind): the kind of most values."""
    best = counts.groupBy("store_id", "cid", "pos").agg(F.min(F.struct((-F.col("n")).alias("less"), "kind")).alias("b"))
    return best.select("store_id", "cid", "pos", F.col("b.kind").alias("kind"))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("store_id", pa.int32()), ("cid", pa.int32()), ("pos", pa.int32()), ("slot", pa.int32()), ("low", pa.int64())])
    for batch in batches:
        least: dict[tuple, int] = {}
        for store, cid, payload in zip(batch["store_id"].to_pylist(), batch["cid"].to_pylist(), batch["payload"].to_pylist()):
            try:
                row = json.loads(payload)
            except (ValueError, RecursionError):
                continue
            if type(row) is not list:
                continue
            for pos, value in enumerate(row):
                if value is not None:
                    h = zlib.crc32((value if type(value) is str else repr(value)).encode("utf-8", "replace"))
                    key = (store, cid, pos, h % SLOTS)
                    if h < least.get(key, 1 << 32):
                        least[key] = h
        if least:
            cols = list(zip(*[(*k, v) for k, v in least.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def value_sketches(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """(store_id, cid, pos, sketch map<slot, least hash>) for the shapes in wanted; combined per batch before the shuffle."""
    rows = spread(intact_rows(objects).where("payload is not null").select("store_id", "cid", "payload"))
    rows = rows.join(if_small(wanted), ["store_id", "cid"], "left_semi")
    slots = rows.mapInArrow(_sketch, "store_id int, cid int, pos int, slot int, low bigint").groupBy("store_id", "cid", "pos", "slot").agg(F.min("low").alias("low"))
    return slots.groupBy("store_id", "cid", "pos").agg(F.map_from_entries(F.collect_list(F.struct("slot", "low"))).alias("sketch"))


def shape_pairs(store_types: DataFrame) -> DataFrame:
    """(store_id, name, old_cid, cid, old_fields, fields): each shape beside the one before."""
    w = Window.partitionBy("store_id", "name").orderBy("cid")
    s = shapes(store_types).where("name is not null")
    both = s.withColumn("old_cid", F.lag("cid").over(w)).withColumn("old_fields", F.lag("fields").over(w))
    return both.where("old_cid is not null").select("store_id", "name", "old_cid", "cid", "old_fields", "fields")


def assign(scores: np.ndarray) -> list[int]:
    """For each row the column of an assignment with the greatest total score (rows <= columns), by shortest augmenting paths."""
    n, m = scores.shape
    cost = scores.max() - scores
    u, v, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        r, at, j = row, 0.0, -1
        while True:
            alt = at + cost[r] - u[r] - v
            better = ~done & (alt < dist)
            dist[better], prev[better] = alt[better], j
            j = int(np.where(done, np.inf, dist).argmin())
            at, done[j] = dist[j], True
            if match[j] < 0:
                break
            r = match[j]
        u[row] += at
        for c in np.flatnonzero(done):
            if match[c] >= 0:
                u[match[c]] += at - dist[c]
            v[c] += dist[c] - at
        while prev[j] >= 0:
            match[j] = match[prev[j]]
            j = prev[j]
        match[j] = row
    out = [-1] * n
    for c, r in enumerate(match):
        if r >= 0:
            out[r] = c
    return out


def match_columns(candidates: list[dict]) -> list[dict]:
    """The best one-to-one matching of vanished to new fields. A vanished field that several new ones declare as theirs takes part once for each."""
    new = sorted({c["new"] for c in candidates})
    declared = {c["old"]: 0 for c in candidates}
    for c in candidates:
        declared[c["old"]] += c["score"] >= DECLARED
    old = [o for o in sorted(declared) for _ in range(max(1, declared[o]))]
    by = {(c["old"], c["new"]): c["score"] for c in candidates}
    scores = np.array([[by.get((o, x), 0.0) for o in old] for x in new])
    if len(new) > len(old):
        scores = np.hstack([scores, np.zeros((len(new), len(new) - len(old)))])
    return [{"old": old[j], "new": x, "score": by[old[j], x]} for x, j in zip(new, assign(scores)) if 0 <= j < len(old) and (old[j], x) in by]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("score", T.DoubleType())])))
def _matched(groups: pd.Series) -> pd.Series:
    return groups.map(lambda g: match_columns(list(g)))


class Drift:
    """The changes between the shapes of record logs, and the tables that unify them."""

    def __init__(self, objects: DataFrame, store_types: DataFrame, field_specs: DataFrame):
        self.objects, self.store_types = objects, store_types
        self.declared = field_specs.where("renamed_from is not null").select(F.col("typename").alias("name"), F.col("name").alias("new"), F.col("renamed_from").alias("old")).distinct()
        self.pairs = materialize(shape_pairs(store_types), "shape-pairs")
        self.kinds = materialize(usual_kinds(kind_counts(objects)), "kinds")

    def candidates(self) -> DataFrame:
        """(store_id, name, old_cid, cid, old, new): every vanished beside every new field of one pair of shapes."""
        gone, new = F.array_except("old_fields", "fields"), F.array_except("fields", "old_fields")
        cols = ["store_id", "name", "old_cid", "cid"]
        return self.pairs.select(*cols, "old_fields", "fields", F.explode(gone).alias("old"), new.alias("news")).select(
            *cols, "old_fields", "fields", "old", F.explode("news").alias("new")
        )

    def matches(self) -> DataFrame:
        """(store_id, name, old_cid, cid, old, new, score, declared): renames as the matching finds them, likely or not."""
        cand = self.candidates().withColumns({"old_pos": F.array_position("old_fields", F.col("old")) - 1, "pos": F.array_position("fields", F.col("new")) - 1})
        cand = materialize(cand.drop("old_fields", "fields"), "candidates")
        wanted = materialize(cand.select("store_id", "cid").union(cand.select("store_id", F.col("old_cid").alias("cid"))).distinct(), "wanted")
        sketches = materialize(value_sketches(self.objects, wanted), "sketches")
        profile = self.kinds.join(sketches, ["store_id", "cid", "pos"], "left")
        old = profile.select("store_id", F.col("cid").alias("old_cid"), F.col("pos").cast("bigint").alias("old_pos"), F.col("kind").alias("old_kind"), F.col("sketch").alias("old_sketch"))
        now = profile.select("store_id", "cid", F.col("pos").cast("bigint").alias("pos"), "kind", "sketch")
        both = cand.join(old, ["store_id", "old_cid", "old_pos"], "left").join(now, ["store_id", "cid", "pos"], "left")
        both = both.join(self.declared.withColumn("declared", F.lit(True)), ["name", "old", "new"], "left")
        likeness = 1 - F.levenshtein("old", "new") / F.greatest(F.length("old"), F.length("new"), F.lit(1))
        shared = F.size(F.map_filter("sketch", lambda k, v: F.get(F.map_values(F.map_filter("old_sketch", lambda a, b: a == k)), F.lit(0)) == v)) / F.lit(SLOTS)
        score = (
            likeness
            + F.coalesce((F.col("old_kind") == F.col("kind")).cast("double"), F.lit(0.25))
            + F.coalesce(F.greatest(shared, F.lit(0.0)), F.lit(0.0))
            + F.when(F.col("declared"), F.lit(DECLARED)).otherwise(0.0)
        )
        keys = ["store_id", "name", "old_cid", "cid"]
        grouped = both.groupBy(*keys).agg(F.collect_list(F.struct("old", "new", score.alias("score"))).alias("c"))
        found = grouped.select(*keys, F.inline(_matched("c")))
        return found.withColumn("declared", F.col("score") >= DECLARED)

    def changes(self, matches: DataFrame | None = None) -> DataFrame:
        """(store_id, cid, field, change): renamed, added, removed and retyped fields, renames being those declared."""
        renamed = materialize((matches or self.matches()).where("declared").select("store_id", "cid", "old_cid", "old", "new"), "renames")
        p = self.pairs
        key = ["store_id", "cid", "old_cid"]
        r_new, r_old = renamed.select(*key, F.col("new").alias("field")), renamed.select(*key, F.col("old").alias("field")).distinct()
        added = p.select(*key, F.explode(F.array_except("fields", "old_fields")).alias("field")).join(r_new, [*key, "field"], "left_anti")
        removed = p.select(*key, F.explode(F.array_except("old_fields", "fields")).alias("field")).join(r_old, [*key, "field"], "left_anti")
        same = p.select(*key, "fields", "old_fields", F.explode(F.array_intersect("fields", "old_fields")).alias("new")).withColumn("old", F.col("new"))
        moved = renamed.join(p.select(*key, "fields", "old_fields"), key).select(*key, "fields", "old_fields", "new", "old")
        kept = same.unionByName(moved).select(
            *key, F.col("new").alias("field"), (F.array_position("fields", F.col("new")) - 1).cast("int").alias("pos"), (F.array_position("old_fields", F.col("old")) - 1).cast("int").alias("old_pos")
        )
        k = self.kinds
        old = k.select("store_id", F.col("cid").alias("old_cid"), F.col("pos").alias("old_pos"), F.col("kind").alias("old_kind"))
        retyped = kept.join(k, ["store_id", "cid", "pos"]).join(old, ["store_id", "old_cid", "old_pos"]).where("kind <> old_kind")
        out = [r_new.withColumn("change", F.lit("renamed")), added.withColumn("change", F.lit("added")), removed.withColumn("change", F.lit("removed")), retyped.withColumn("change", F.lit("retyped"))]
        cols = ["store_id", "cid", "field", "change"]
        return out[0].select(cols).union(out[1].select(cols)).union(out[2].select(cols)).union(out[3].select(cols)).distinct()

    def likely(self, matches: DataFrame) -> DataFrame:
        """The matches that nobody declared but that score LIKELY or more."""
        return matches.where(~F.col("declared") & (F.col("score") >= LIKELY))

    def renames(self, matches: DataFrame | None) -> DataFrame:
        """(name, old, new) of each type: what is declared, and what the matching finds likely in any of its stores."""
        pairs = self.declared.select("name", "old", "new")
        if matches is not None:
            pairs = pairs.union(self.likely(matches).select("name", "old", "new"))
        return pairs.where("name is not null and old is not null and new is not null").distinct()

    def lineage(self, matches: DataFrame | None) -> DataFrame:
        """(store_id, cid, name, width, names array<struct<name, pos>>): what the fields of each shape are called in the table of its type."""
        pairs = self.renames(matches).groupBy("name").agg(F.collect_list(F.struct("old", "new")).alias("pairs"))
        listed = F.coalesce("pairs", F.array().cast("array<struct<old:string,new:string>>"))
        return shapes(self.store_types).join(pairs, "name", "left").select("store_id", "cid", "name", F.size("fields").alias("width"), _unified_names("fields", listed).alias("names"))

    def unified(self, matches: DataFrame | None = None) -> DataFrame:
        """(name, store_id, oid, tid, cid, row map<field, text>, rest): every version under the names that its type gives its fields, in all stores and shapes.

        With matches, undeclared renames that are likely unify too. rest has what no field of the shape holds.
        """
        rows = intact_rows(self.objects).where("payload is not null").select("store_id", "oid", "tid", "cid", "payload").dropDuplicates(["store_id", "oid", "tid", "cid"])
        joined = rows.join(self.lineage(matches), ["store_id", "cid"], "left").withColumn("values", F.from_json("payload", "array<string>"))
        known = F.col("values").isNotNull() & F.col("names").isNotNull()
        held = F.filter("names", lambda x: x["pos"] < F.size("values"))
        row = F.map_from_arrays(F.transform(held, lambda x: x["name"]), F.transform(held, lambda x: F.get("values", x["pos"])))
        beyond = F.when(F.size("values") > F.col("width"), F.to_json(F.slice("values", F.col("width") + 1, F.size("values"))))
        return joined.select("name", "store_id", "oid", "tid", "cid", F.when(known, row).alias("row"), F.when(known, beyond).otherwise(F.col("payload")).alias("rest"))

    def columns(self, matches: DataFrame | None = None) -> DataFrame:
        """(name, field, kind, shapes): the fields of each type's table, their one kind, and in how many shapes they have values."""
        fields = self.lineage(matches).select("store_id", "cid", "name", F.inline("names").alias("field", "pos"))
        kinds = fields.join(self.kinds, ["store_id", "cid", "pos"]).groupBy("name", "field").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("shapes"))
        numbers = F.size(F.array_except("kinds", F.array(F.lit("int"), F.lit("float")))) == 0
        kind = F.when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).when(numbers, F.lit("float")).otherwise(F.lit("string"))
        return kinds.select("name", "field", kind.alias("kind"), "shapes")

    def table(self, typename: str, matches: DataFrame | None = None) -> DataFrame:
        """The one table of a type, with a column of its kind for every field it ever had."""
        found = sorted(tuple(r) for r in self.columns(matches).where(F.col("name") == typename).select("field", "kind").collect())
        return type_table(self.unified(matches), typename, {f: COLUMN_TYPES[k] for f, k in found}, {f for f, k in found if k == "ref"})


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("pos", T.IntegerType())])))
def _unified_names(fields: pd.Series, pairs: pd.Series) -> pd.Series:
    return pd.Series([[{"name": n, "pos": i} for i, names in enumerate(unified_names(list(f), list(p))) for n in names] for f, p in zip(fields, pairs)])


def unified_names(fields: list[str], pairs: list[dict]) -> list[list[str]]:
    """The names of each field of a shape in its type's table: the last that the renames (old, new) of the type give it.

    A name that the shape itself holds, or that an earlier field took, is not given; a field that several new ones
    replace has all those names, as each of them is read from it.
    """
    taken, out = set(fields), []
    for name in fields:
        ends, todo, seen = [], [name], {name}
        while todo:
            at = todo.pop(0)
            onward = sorted({d["new"] for d in pairs if d["old"] == at} - taken - seen)
            seen.update(onward)
            todo += onward
            if not onward:
                ends.append(at)
        # a shape that lists a field twice keeps the first
        out.append([e for e in ends if not any(e in o for o in out)])
        taken.update(ends)
    return out


def type_table(unified: DataFrame, typename: str, fields: dict[str, str], refs: frozenset[str] | set[str] = frozenset()) -> DataFrame:
    """One type's table with a typed column per field; a value of another kind is null in its column and stays in `row`. Of a reference the column has its oid."""
    rows = unified.where(F.col("name") == typename)
    text = lambda f: F.get_json_object(F.col("row")[f], "$['$ref']") if f in refs else F.col("row")[f]
    cast = lambda f, t: text(f) if t == "string" else text(f).try_cast(t)
    return rows.select("store_id", "oid", "tid", "cid", *[cast(f, t).alias(f"f_{f}" if f in ("store_id", "oid", "tid", "cid", "row", "rest") else f) for f, t in fields.items()], "row", "rest")

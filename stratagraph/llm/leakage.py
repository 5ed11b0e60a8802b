"""Problem 6: passages of held-out items in a training corpus.

The corpus is kept as a distributed positional inverted index: it is split into shards of documents, and each shard is
one row with its terms in order, how often each occurs, and its postings (the places of each term, the shard's words
being numbered through). A search goes from the items to the postings: of an item's phrases of SEED words only those
are followed whose words all stand in the shard's list of terms; each starts at the postings of its rarest word there,
and the offset-adjusted lists of the other words are intersected from rare to frequent. With at most one edit in six
words, a passage of WORDS words or more has SEED words in a row intact, so no passage is missed. A run of phrases that
holds WORDS words is an exact phrase; other runs are extended both ways by the furthest-reaching alignment for each
number of edits, which gives proximity matches.

Items of up to BROADCAST_CHARS characters go to every shard together. Beyond that the items are joined to the shards by
their words: by the shards' lists of terms each item goes to those shards alone that hold all the words of one of its
phrases, so any number of items takes one pass over the postings and none comes to the driver.

Defined results: words are runs of letters and digits after decoding entities and escapes and dropping markup, case,
accents, and invisible characters; markup is the known HTML tags (with up to three attributes without a value), and any other tag whose attributes all have values
and that doesn't follow a word directly; null or empty texts hold nothing, an item without prompt and answer or with
fewer than WORDS words is never found; words split by punctuation alone ("43.7", "SP-12") are also looked for joined;
repeated items and documents each come out under their own id, a pair once; empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, spread

WORDS = 12
#: A passage may have one edit in so many words.
EDIT_IN = 6
SEED = 4
#: Characters of items that are sent to every shard (as words and phrases some 8 bytes for each).
BROADCAST_CHARS = 16_000_000
#: Items that meet a shard at once where they are joined to it.
SLICE_ITEMS = 5_000
#: Documents and characters of a shard at most; a longer document is a shard of its own.
SHARD_DOCS, SHARD_CHARS = 2_000, 8_000_000
#: Occurrences followed at once within a shard.
AT_ONCE = 2_000_000
INDEX = "shard bigint, docs array<bigint>, sizes array<int>, terms array<string>, counts array<int>, places array<int>"
FOUND = "item_id bigint, doc_id bigint, words int, edits int, item_start int, doc_start int"

# Marks and invisible characters, as ranges found by category.
_drop = [c for c in range(0x10000) if unicodedata.category(chr(c)) in ("Mn", "Me", "Cf")]
_UNSEEN = re.compile("[" + "".join(re.escape(chr(c)) for c in _drop) + "]+")
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in _drop if unicodedata.category(chr(c)) == "Cf") + "]+")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrt\"/\\]))")
# Names of HTML elements within a line, and of those that part words. Fixed values of the format.
_IN_LINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr"
_BLOCKS = (
    "address article aside audio base blockquote body br button canvas caption center col colgroup dd details dialog div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe img input legend li link main map meta nav noscript object ol optgroup option p param picture pre progress script section select "
    "source style summary svg table tbody td template textarea tfoot th thead title tr track ul video"
)
_VALUE = r"""\s*=\s*(?:"[^"<>]{0,300}"|'[^'<>]{0,300}'|[^\s"'<>=]{1,300})"""
_NAME = r"[A-Za-z_:][\w:.-]{0,60}"
_ATTRIBUTES = rf"(?:\s+{_NAME}{_VALUE}){{0,20}}(?:\s+{_NAME}){{0,3}}(?:\s+{_NAME}{_VALUE}){{0,20}}\s*/?>"
_INLINE = re.compile(rf"<\s*/?(?:{'|'.join(_IN_LINE.split())}){_ATTRIBUTES}", re.I)
_BLOCK = re.compile(rf"<\s*/?(?:{'|'.join(_BLOCKS.split())}){_ATTRIBUTES}|<!--.{{0,2000}}?-->|<!doctype\b[^<>]{{0,200}}>", re.I | re.S)
_OTHER = re.compile(rf"(?<!\w)<\s*/?{_NAME}(?:\s+{_NAME}{_VALUE}){{0,20}}\s*/?>")
_WORD = re.compile(r"[^\W_]+")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " " if m[3] in "nrt" else m[3]


def plain(text: str) -> str:
    """The text without escapes, markup, case and forms of characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    for _ in range(2):
        if "\\" in text:
            text = _ESCAPE.sub(_unescape, text)
        if "&" in text:
            text = html.unescape(text)
        if not text.isascii():
            text = _INVISIBLE.sub("", text)
    if "<" in text:
        text = _OTHER.sub(" ", _BLOCK.sub(" ", _INLINE.sub("", text)))
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


def bare_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits of the text as it stands."""
    return _WORD.findall(text.lower()) if text else []


def joined_words(text: str) -> tuple[list[str], list[int]]:
    """The words with those joined that only punctuation parts, and how many words each stands for."""
    parts = [_WORD.findall(chunk) for chunk in plain(text).split()]
    return ["".join(p) for p in parts if p], [len(p) for p in parts if p]


def _shards(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    low, size = 0, 0
    for k, t in enumerate(texts):
        if k > low and (k - low >= SHARD_DOCS or size + len(t or "") > SHARD_CHARS):
            yield low, k
            low, size = k, 0
        size += len(t or "")
    if low < len(texts):
        yield low, len(texts)


def _inverted(words: Callable[[str | None], list[str]]):
    """Arrow batches of (doc_id, text) to shards. The postings of a shard are its words numbered through, with SEED numbers left free after each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, made = TaskContext.get(), 0
        task = context.partitionId() if context else 0
        for batch in batches:
            texts = batch["text"].to_pylist()
            for low, high in _shards(texts):
                lists = [words(t) for t in texts[low:high]]
                sizes = np.array([len(x) for x in lists], np.int64)
                flat = pa.array([w for x in lists for w in x], pa.string()).dictionary_encode()
                order = pc.sort_indices(flat.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                code = rank[flat.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.int64)
                at = np.arange(len(code)) + np.repeat(np.arange(len(lists)) * SEED, sizes)
                counts = np.bincount(code, minlength=len(order)).astype(np.int32)
                one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind) if not isinstance(values, pa.Array) else values)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(task << 32) + made], pa.int64()), one(batch["doc_id"].slice(low, high - low), pa.int64()), one(sizes.astype(np.int32), pa.int32()),
                        one(flat.dictionary.take(pa.array(order)), pa.string()), one(counts, pa.int32()), one(at[np.argsort(code, kind="stable")].astype(np.int32), pa.int32()),
                    ],
                    names=["shard", "docs", "sizes", "terms", "counts", "places"],
                )
                made += 1

    return run


def positional_index(documents: DataFrame, words: Callable[[str | None], list[str]] = words_of) -> DataFrame:
    """The inverted index of the documents, one row per shard. Written once (write_index) it serves any number of searches."""
    texts = documents.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return spread(texts).mapInArrow(_inverted(words), INDEX)


def write_index(documents: DataFrame, path: str, words: Callable[[str | None], list[str]] = words_of) -> None:
    positional_index(documents, words).write.parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """Items as searchable word lists: vocabulary, phrases of SEED words, and where each phrase stands in which item."""

    def __init__(self, items: list[tuple[int, str]], words: Callable[[str | None], list[str]] = words_of):
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        self.weights: list[list[int]] = []
        vocabulary: dict[str, int] = {}
        for item_id, text in items:
            plain_words = words(text)
            if len(plain_words) < WORDS:
                continue
            joined, counts = joined_words(text) if words is words_of else (plain_words, [])
            variants = [(plain_words, [1] * len(plain_words))] + [(joined, counts)] * (joined != plain_words)
            for row, weights in variants:
                self.ids.append(item_id)
                self.words.append([vocabulary.setdefault(w, len(vocabulary)) for w in row])
                self.weights.append(np.r_[0, np.cumsum(weights)].tolist())
        self.vocabulary = list(vocabulary)
        sizes = np.array([len(w) for w in self.words], np.int64)
        flat = np.array([w for row in self.words for w in row], np.int64)
        starts = np.flatnonzero(np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) <= np.repeat(sizes - SEED, sizes)) if len(flat) else np.zeros(0, np.int64)
        grams = flat[starts[:, None] + np.arange(SEED)].reshape(-1, SEED)
        self.phrases, which = np.unique(grams, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        item = np.repeat(np.arange(len(sizes)), sizes)
        # the places of phrase p: rows first[p] to first[p + 1] of (place_item, place_at)
        self.first = np.r_[0, np.cumsum(np.bincount(which.ravel(), minlength=len(self.phrases)))]
        self.place_item = item[starts[order]]
        self.place_at = starts[order] - (np.cumsum(sizes) - sizes)[self.place_item]
        self.weight_start = np.r_[0, np.cumsum(sizes + 1)]
        self.weight = np.array([w for row in self.weights for w in row], np.int64)


def reach(item: list[int], i: int, doc: list[int], j: int, step: int, most: int) -> list[int]:
    """For each number of edits up to most, how many item words from i on (in direction step) an alignment from doc word j on can take."""
    n = len(item) - i if step > 0 else i + 1
    m = len(doc) - j if step > 0 else j + 1
    n, m = max(n, 0), max(m, 0)

    def slide(k: int, d: int) -> int:
        while k < n and 0 <= k + d < m and item[i + step * k] == doc[j + step * (k + d)]:
            k += 1
        return k

    at = {0: slide(0, 0)}
    best = [at[0]]
    for e in range(1, most + 1):
        if best[-1] >= n:
            break
        now = {}
        for d in range(-e, e + 1):
            k = -1
            if d in at:
                k = at[d] + 1
            if d + 1 in at:
                k = max(k, at[d + 1] + 1)
            if d - 1 in at:
                k = max(k, at[d - 1])
            if k < 0:
                continue
            k = min(k, n, m - d)
            if k >= 0 and k + d >= 0:
                now[d] = slide(k, d)
        at = now or at
        best.append(max([best[-1] + 1, *now.values()]) if best[-1] < n else n)
    return [min(x, n) for x in best]


def passage(item: list[int], weights: list[int], doc: list[int], i: int, j: int) -> tuple[int, int, int, int] | None:
    """(words, edits, item start, doc start) of a passage round the phrase at item word i and doc word j, if there is one.

    A passage of twice WORDS or more splits into two of WORDS or more, one of which has no more than its share of the
    edits. So the one with the fewest edits is found among those too short to split, whatever the item's length.
    """
    widest = max(b - a for a, b in zip(weights, weights[1:]))
    most = min(weights[-1], 2 * WORDS - 2 + widest) // EDIT_IN
    right = reach(item, i + SEED, doc, j + SEED, 1, most)
    left = reach(item, i - 1, doc, j - 1, -1, most)
    for edits in range(most + 1):
        found = None
        for a in range(edits + 1):
            x, y = left[min(a, len(left) - 1)], right[min(edits - a, len(right) - 1)]
            words = weights[i + SEED + y] - weights[i - x]
            if words >= max(WORDS, EDIT_IN * edits) and (found is None or words > found[0]):
                found = (words, edits, i - x, max(j - x, 0))
        if found:
            return found
    return None


def _occurrences(q: Queries, terms: pa.Array, counts: np.ndarray, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, place of its first word) of every occurrence of the phrases whose words all stand in the shard."""
    at = pc.index_in(pa.array(q.vocabulary, pa.string()), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    if not (at >= 0).any():
        return
    starts = np.cumsum(counts) - counts
    keys = np.repeat(np.arange(len(counts)) << 32, counts) + places
    held = at[q.phrases]
    live = np.flatnonzero((held >= 0).all(axis=1))
    each = counts[held[live]]
    rank = np.argsort(each, axis=1, kind="stable")  # from the rarest word to the most frequent
    upto = np.cumsum(np.take_along_axis(each, rank[:, :1], axis=1)[:, 0]) if len(live) else np.zeros(0, np.int64)
    low = 0
    while low < len(live):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + AT_ONCE, side="right")))
        ph, rk = live[low:high], rank[low:high]
        low = high
        rare = held[ph, rk[:, 0]]
        size = counts[rare]
        row = np.repeat(np.arange(len(ph)), size)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        base = places[starts[rare][row] + inner] - rk[row, 0]
        for k in range(1, SEED):
            col = rk[row, k]
            want = (held[ph[row], col] << 32) + base + col
            slot = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = (keys[slot] == want) & (base + col >= 0)
            row, base = row[hit], base[hit]
        yield ph[row], base


def _shard_matches(q: Queries, row: dict, exact: bool) -> list[tuple]:
    """The best passage of each item in each document of a shard: fewest edits, then most words."""
    counts, places, sizes = (row[c].astype(np.int64) for c in ("counts", "places", "sizes"))
    found = list(_occurrences(q, row["terms"], counts, places))
    if not found:
        return []
    phrase, base = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    many = q.first[phrase + 1] - q.first[phrase]
    slot = np.repeat(q.first[phrase] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    base = np.repeat(base, many)
    item, i = q.place_item[slot], q.place_at[slot]
    begins = np.cumsum(sizes + SEED) - (sizes + SEED)
    doc = np.searchsorted(begins, base, side="right") - 1
    j = base - begins[doc]
    # phrases that follow each other on one diagonal are one run of equal words
    order = np.lexsort((i, j - i, item, doc))
    doc, item, i, j = doc[order], item[order], i[order], j[order]
    if not len(doc):
        return []
    new = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)]
    head = np.flatnonzero(new)
    length = np.diff(np.r_[head, len(new)]) + SEED - 1
    doc, item, i, j = doc[head], item[head], i[head], j[head]
    weight = q.weight[q.weight_start[item] + i + length] - q.weight[q.weight_start[item] + i]
    ids = row["docs"]
    best: dict[tuple, tuple] = {}

    def offer(n: int, got: tuple) -> None:
        key = (q.ids[item[n]], int(doc[n]))
        if key not in best or (got[1], -got[0]) < (best[key][1], -best[key][0]):
            best[key] = got

    for n in np.flatnonzero(weight >= WORDS).tolist():
        offer(n, (int(weight[n]), 0, int(i[n]), int(j[n])))
    if not exact:
        text, at = np.full(int((sizes + SEED).sum()), -1, np.int64), pc.index_in(row["terms"], value_set=pa.array(q.vocabulary, pa.string())).fill_null(-1)
        text[places] = np.repeat(at.to_numpy(zero_copy_only=False), counts)
        words: dict[int, list[int]] = {}
        for n in np.flatnonzero(weight < WORDS).tolist():
            d = int(doc[n])
            known = best.get((q.ids[item[n]], d))
            if known and known[1] == 0:
                continue
            if d not in words:
                words[d] = text[begins[d] : begins[d] + sizes[d]].tolist()
            if got := passage(q.words[item[n]], q.weights[item[n]], words[d], int(i[n]), int(j[n])):
                offer(n, got)
    return [(item_id, ids[d], *got) for (item_id, d), got in best.items()]


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield {"docs": batch["docs"][k].as_py(), "terms": batch["terms"][k].values} | {c: batch[c][k].values.to_numpy() for c in ("sizes", "counts", "places")}


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[2:]]],
        names=["item_id", "doc_id", "words", "edits", "item_start", "doc_start"],
    )


def _search_shared(shared, exact: bool):
    """For shards that all meet the same items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                if rows := _shard_matches(shared.value, row, exact):
                    yield _as_batch(rows)

    return run


def _search_joined(words: Callable[[str | None], list[str]], exact: bool):
    """For shards that come with their own items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, items in zip(_rows(batch), batch["items"]):
                q = Queries([(x["item_id"], x["q"]) for x in items.as_py()], words)
                if q.ids and (rows := _shard_matches(q, row, exact)):
                    yield _as_batch(rows)

    return run


def _phrases(words: Callable[[str | None], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, grams = [], []
            for item_id, text in zip(batch["item_id"].to_pylist(), batch["q"].to_pylist()):
                q = Queries([(item_id, text)], words)
                grams += [[q.vocabulary[w] for w in p] for p in q.phrases.tolist()]
                ids += [item_id] * len(q.phrases)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(grams, pa.list_(pa.string()))], names=["item_id", "gram"])

    return run


def shards_of_items(index: DataFrame, items: DataFrame, words: Callable[[str | None], list[str]]) -> DataFrame:
    """(shard, item_id): the shards that hold all the words of one of an item's phrases, by the lists of terms alone.

    A phrase meets the shards of its rarest word only; the other words narrow them down one by one.
    """
    terms = index.select("shard", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("shard", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    grams = materialize(items.mapInArrow(_phrases(words), "item_id bigint, gram array<string>"), "grams")
    asked = grams.select(F.explode("gram").alias("term")).distinct()
    held = materialize(terms.join(asked, "term", "left_semi").select("term", "shard", "n"), "held-terms")
    often = held.groupBy("term").agg(F.sum("n").alias("n"))
    phrase = grams.select("gram").distinct().withColumn("phrase", F.xxhash64("gram"))
    ranked = (
        phrase.select("phrase", F.posexplode("gram").alias("at", "term"))
        .join(often, "term")
        .groupBy("phrase")
        .agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("w"))
        .where(F.size("w") >= SEED)
    )
    met = ranked.select("phrase", "w", F.get("w", F.lit(0))["term"].alias("term")).join(held.drop("n"), "term").drop("term")
    for k in range(1, SEED):
        met = met.withColumn("term", F.get("w", F.lit(k))["term"]).join(held.drop("n"), ["term", "shard"], "left_semi").drop("term")
    return grams.select("item_id", F.xxhash64("gram").alias("phrase")).join(met.select("phrase", "shard"), "phrase").select("shard", "item_id").distinct()


def search(index: DataFrame, items: DataFrame, words: Callable[[str | None], list[str]] = words_of, exact: bool = False) -> DataFrame:
    """(item_id, doc_id, words, edits, item_start, doc_start): a passage of each item that each document holds, the one with the fewest edits.

    words is what the index was made with; exact finds only passages without edits.
    """
    spark = index.sparkSession
    rows = items.where("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), F.concat_ws(" ", "prompt", "answer").alias("q")).distinct()
    if (rows.agg(F.sum(F.length("q"))).first()[0] or 0) <= BROADCAST_CHARS:
        queries = Queries([(r.item_id, r.q) for r in rows.collect()], words)
        if not queries.ids:
            return spark.createDataFrame([], FOUND)
        found = index.mapInArrow(_search_shared(spark.sparkContext.broadcast(queries), exact), FOUND)
    else:
        met = shards_of_items(index, rows, words).join(rows, "item_id")
        # a shard that many items name meets them in slices, so that none gathers in one row
        slices = F.ceil(F.approx_count_distinct("item_id") / SLICE_ITEMS).cast("int")
        many = met.groupBy("shard").agg(slices.alias("slices"))
        packs = (
            met.join(many, "shard")
            .groupBy("shard", F.pmod(F.xxhash64("item_id"), F.col("slices")).alias("slice"))
            .agg(F.collect_list(F.struct("item_id", "q")).alias("items"))
        )
        found = index.join(packs.drop("slice"), "shard").mapInArrow(_search_joined(words, exact), FOUND)
    return found.groupBy("item_id", "doc_id").agg(F.min(F.struct("edits", (-F.col("words")).alias("less"), "item_start", "doc_start")).alias("b")).select(
        "item_id", "doc_id", (-F.col("b.less")).alias("words"), "b.edits", "b.item_start", "b.doc_start"
    )


def leaks(documents: DataFrame, items: DataFrame, words: Callable[[str | None], list[str]] = words_of, exact: bool = False) -> DataFrame:
    """Stores the corpus' index and searches it for every item."""
    return search(materialize(positional_index(documents, words), "postings"), items, words, exact)

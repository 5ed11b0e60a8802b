"""The text operators against plain versions, with the odd cases their docstrings define."""

import random

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from stratagraph.llm import leakage, mixture, splitting
from stratagraph.llm import tokens as token_rules

TOKEN = regex.compile(token_rules.TOKEN)
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, title string, subject_qid string, tokens int, copies int"
ITEMS = "item_id bigint, suite string, lang string, prompt string, answer string, split string, doc_id bigint"
PLANS = "plan_id int, source string, target_share double, max_repeats int, total_ratio double, tokens int"
RULES = "source string, max_tokens int, overlap_tokens int, tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, None, 7, 7) for i, t, s in rows], DOCS)


# -- 6


def has_passage(item: list[str], doc: list[str]) -> bool:
    """Every window of the item of 12 words or more against every place of the document, by edit distance."""
    for i in range(len(item)):
        for j in range(i + leakage.WORDS, len(item) + 1):
            window = item[i:j]
            row = [0] * (len(doc) + 1)
            for a, w in enumerate(window, 1):
                diagonal, row[0] = row[0], a
                for b, d in enumerate(doc, 1):
                    diagonal, row[b] = row[b], min(diagonal + (w != d), row[b] + 1, row[b - 1] + 1)
            if min(row) * leakage.EDIT_IN <= len(window):
                return True
    return False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leaks(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    items = [(i, [rng.choice(words) for _ in range(rng.choice([5, 12, 20, 30]))]) for i in range(12)]
    rows = []
    for n in range(70):
        text = [rng.choice(words) for _ in range(rng.randrange(25))]
        if rng.random() < 0.7:
            part = list(rng.choice(items)[1])
            start = rng.randrange(max(1, len(part) - 14))
            part = part[start : start + rng.choice([9, 10, 11, 12, 13, 18, 25])]
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                k = rng.randrange(len(part))
                part[k : k + 1] = rng.choice([[], ["zz"], [part[k], "zz"]])
            text[len(text) // 2 : len(text) // 2] = part
        rows.append((n, " ".join(text), "s"))
    it = spark.createDataFrame([(i, "s", "en", " ".join(w[:8]), " ".join(w[8:]) or None, "test", 1) for i, w in items], ITEMS)
    got = {(r["item_id"], r["doc_id"]) for r in leakage.leaks(docs(spark, rows), it).collect()}
    want = {(i, n) for i, w in items for n, t, _ in rows if has_passage(w, t.split())}
    assert got == want and want


PASSAGE = "Work out what follows for link 15 to Ploanneyite when Ferr-bumlite vanishes at mark 43.7 & l'hiver é"


@pytest.mark.parametrize(
    "form",
    [
        PASSAGE, PASSAGE.upper(), PASSAGE.replace(" ", "\n\t "), PASSAGE.replace("link", "<b>link</b>").replace("&", "&amp;"), PASSAGE.replace("15", "１５").replace("o", "o­"),
        PASSAGE.replace("é", "\\u00e9").replace("to", "\\u200bto"), PASSAGE.replace("é", "é"), "| " + PASSAGE.replace(" ", " | ") + " |", PASSAGE.replace("follows", "**follows**").replace("link", "<ma​rk>link</mark>"),
        PASSAGE.replace("-", "").replace("43.7", "437").replace("'", ""), "so " * 30 + PASSAGE + " so" * 30, "x" * 200_000 + " " + PASSAGE,
    ],
)
def test_forms(form):
    assert found([(1, PASSAGE + " and then some more")], [form])


def found(items, texts):
    """The documents, by number, that hold a passage of an item, without Spark."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    q, out = leakage.Queries(items), set()
    for shard in leakage._inverted(leakage.words_of)(iter([batch])):
        for row in leakage._rows(shard):
            out |= {(r[0], r[1]) for r in leakage._shard_matches(q, row, False)}
    return out


def test_what_is_no_markup():
    text = "fifteen words that stand between two signs and are no tag at all here now"
    items = [(1, text)]
    assert found(items, [f"for i <n do {text} until k> 3", f"a <b {text} c> d", f"List<String> {text}", f'<p class="x">{text}</p>', f"<!-- note -->{text}", f"if x <y and {text}> z"]) == {(1, k) for k in range(6)}
    assert leakage.plain("Map<String> a<b>b</b> <x y='1'>z").split() == ["map<string>", "ab", "z"]


def test_leaks_odd(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, PASSAGE, None), (5, PASSAGE, "s"), (None, PASSAGE, "s"), (6, "no", "s")]
    items = spark.createDataFrame([(1, None, None, PASSAGE, None, None, 1), (2, None, None, None, None, None, 1), (3, None, None, "too few words", None, None, 1), (None, None, None, PASSAGE, None, None, 1), (1, None, None, PASSAGE, None, None, 1)], ITEMS)
    found = leakage.leaks(docs(spark, rows), items).collect()
    assert sorted((r["item_id"], r["doc_id"] or 0) for r in found) == [(1, 0), (1, 4), (1, 5)] and {r["edits"] for r in found} == {0}
    none = spark.createDataFrame([], ITEMS)
    assert leakage.leaks(docs(spark, rows), none).count() == 0 and leakage.leaks(docs(spark, []), items).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_items_joined_to_shards(spark, monkeypatch, seed):
    """Items beyond what is broadcast are joined by their words: the same passages, in slices and over several shards."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(40)]
    rows = [(n, " ".join(["x"] * 5 + rng.choice(items)[1].split()[: rng.choice([11, 12, 20])] + ["y"]), "s") for n in range(60)]
    it = spark.createDataFrame([(i, None, None, t, None, None, 1) for i, t in items], ITEMS)
    monkeypatch.setattr(leakage, "SHARD_DOCS", 7)
    want = {tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()}
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 0)
    monkeypatch.setattr(leakage, "SLICE_ITEMS", 3)
    assert {tuple(r) for r in leakage.leaks(docs(spark, rows), it).collect()} == want and len(want) > 20


def test_many_items_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BROADCAST_CHARS", 1000)
    rows = [(n, " ".join(f"a{n}x{k}" for k in range(14)), "s") for n in range(0, 20_000, 40)]
    it = spark.range(20_000).selectExpr("id as item_id", "concat_ws(' ', transform(sequence(0, 13), k -> concat('a', id, 'x', k))) as prompt", "cast(null as string) as answer")
    index = leakage.materialize(leakage.positional_index(docs(spark, rows)), "postings")
    got = leakage.search(index, it)
    assert {(r["item_id"], r["doc_id"]) for r in got.collect()} == {(n, n) for n in range(0, 20_000, 40)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("places") and str(got._jdf.queryExecution().executedPlan()).count("places#") >= 1
    exact = leakage.search(index, it.where("item_id < 41"), exact=True)
    assert {r["item_id"] for r in exact.collect()} == {0, 40}


def test_index_kept(spark, tmp_path):
    leakage.write_index(docs(spark, [(1, PASSAGE, "s"), (2, "no", "s")]), f"file://{tmp_path}/index")
    items = spark.createDataFrame([(1, None, None, PASSAGE, None, None, 1)], ITEMS)
    assert [r["doc_id"] for r in leakage.search(leakage.read_index(spark, f"file://{tmp_path}/index"), items).collect()] == [1]


# -- 7


def corpus(n=3000):
    rng = random.Random(9)
    rows = [(i, "tok " * rng.randrange(1, 60), rng.choice(["a", " A", "b\t", "B", "c", "c", "c", None])) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "b"), (n + 2, "word " * 5000, "c"), (n + 3, " ", "  ")]


def test_mix(spark):
    rows = corpus()
    table = docs(spark, rows)
    size = {}
    for _, t, s in rows:
        size[(s or "").strip().lower()] = size.get((s or "").strip().lower(), 0) + len(TOKEN.findall(t or ""))
    total = sum(size.values())
    plans = [(1, "a", 0.5, 3, 0.4, 7), (1, " B", 0.3, 2, 0.4, 7), (1, "c", 0.2, 1, 0.4, 7), (2, "a", 0.9, 1, 2.0, 7), (2, "none", 0.1, 4, 2.0, 7), (3, None, 0.5, 1, 1.0, 7), (4, "a", None, 1, 1.0, 7), (5, "a", 1.0, None, 3.0, 7), (1, "a", 0.5, 3, 0.4, 7)]
    p = spark.createDataFrame(plans, PLANS)
    rates = {(r["plan_id"], r["source"]): r for r in mixture.plan_rates(mixture.sized(table), p).collect()}
    shares = {(r["plan_id"], r["source"]): r for r in mixture.shares(table, p).collect()}
    assert {k for k, r in shares.items() if not r["feasible"]} == {(2, "a"), (2, "none")} and len(rates) == len(shares) == 6
    assert rates[1, "b"]["available"] == size["b"] and rates[1, "b"]["target"] == pytest.approx(0.3 * 0.4 * total)
    mix = mixture.mix(table, p).collect()
    assert mix == mixture.mix(table, p).collect()  # no state, the same on every run
    per, most = {}, {}
    for r in mix:
        per[r["plan_id"], r["source"]] = per.get((r["plan_id"], r["source"]), 0) + r["tokens"]
        most[r["plan_id"], r["source"]] = max(most.get((r["plan_id"], r["source"]), 0), r["copy"])
    for (plan, source), r in rates.items():
        if shares[plan, source]["feasible"]:
            assert per[plan, source] == pytest.approx(r["target"], rel=0.03)
        if r["max_repeats"] is not None and r["available"]:
            assert most[plan, source] <= r["max_repeats"]
    assert per[2, "a"] == size["a"]
    keys = [r["shuffle_key"] for r in mix if r["plan_id"] == 1]
    assert keys == sorted(keys)
    assert sum(r["share"] for k, r in shares.items() if k[0] == 1) == pytest.approx(1) and shares[2, "none"]["tokens"] == 0
    assert {k: r["tokens"] for k, r in shares.items() if r["tokens"]} == per


def test_mix_empty(spark):
    p = spark.createDataFrame([(1, "a", 0.5, 3, 0.4, 7)], PLANS)
    assert mixture.mix(docs(spark, []), p).count() == 0 and mixture.shares(docs(spark, []), p).first()["feasible"]
    assert mixture.plan_rates(mixture.sized(docs(spark, corpus(5))), spark.createDataFrame([], PLANS)).count() == 0


def reached(mean, cap):
    base, cuts = mixture.poisson_cuts(mean, cap)
    assert (cuts[1:] >= cuts[:-1]).all()
    return base + (1 - cuts).sum()


def test_cut_poisson():
    for rate, cap in ((0.05, 1), (0.9, 1), (0.5, 2), (1.9, 2), (3.0, 7), (9.5, 10), (0.3, None), (20.0, None), (620, 640), (740, None), (800, None), (900, 1000), (1000, None), (1e6, None), (99_990, 100_000)):
        assert reached(mixture.cut_mean(rate, cap), cap) == pytest.approx(rate, rel=1e-6)
    assert reached(1e5, 3) == 3 and reached(0.0, 3) == 0 and reached(1.0, 0) == 0


def test_meeting_mean():
    even = np.full(mixture.BINS, 10.0)
    for rate, cap in ((0.01, None), (0.7, 1), (2.5, 3), (700.0, None)):
        assert mixture.meeting_mean(rate * even.sum(), cap, even) == pytest.approx(mixture.cut_mean(rate, cap), rel=1e-2)
    assert mixture.meeting_mean(5.0, 2, np.zeros(mixture.BINS)) is None


def test_high_rates(spark):
    """A small source repeated 740 times, uncapped and under a cap close by."""
    rows = [(i, "tok " * (1 + i % 5), "a") for i in range(300)] + [(1000 + i, "tok " * 20, "b") for i in range(2000)]
    size = sum(1 + i % 5 for i in range(300))
    total = size + 40_000
    p = spark.createDataFrame([(1, "a", 1.0, None, 740 * size / total, 7), (2, "a", 1.0, 760, 740 * size / total, 7)], PLANS)
    for r in mixture.shares(docs(spark, rows), p).collect():
        assert r["tokens"] == pytest.approx(740 * size, rel=0.01) and r["feasible"]


# -- 8


def texts():
    rng = random.Random(4)
    sentence = lambda: " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(3, 15))) + rng.choice([".", "!", " …", "; and", ""])
    out = ["\n\n".join(" ".join(sentence() for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))) for _ in range(30)]
    out += ["word " * 500, "a.b" * 300, "- item one\r\n- item two\r\n" * 40, "# H\n\ntext here.\n\n\n\n## H2\n" * 30, "x" * 100_000, "é́ ¿qué? " * 100]
    return out


def cut(text, limit, overlap, reach_back=False):
    return splitting.split_spans(text, [m.span() for m in TOKEN.finditer(text)], limit, overlap, reach_back)


@pytest.mark.parametrize("reach_back", [False, True])
@pytest.mark.parametrize("limit,overlap", [(40, 8), (16, 0), (7, 3), (3, 50), (1, 0), (2, 1), (50, 30)])
def test_pieces(limit, overlap, reach_back):
    for text in texts():
        tokens = [m.span() for m in TOKEN.finditer(text)]
        got = cut(text, limit, overlap, reach_back)
        share = max(0, min(overlap, limit - 1))
        assert got[0][0] == 0 and got[-1][1] == len(tokens)
        assert (len(got) > 1) == (len(tokens) > limit)
        for k, (s, e, a, b, o) in enumerate(got):
            assert 0 < e - s <= limit and (a, b) == (tokens[s][0], tokens[e - 1][1])
            assert len(TOKEN.findall(text[a:b])) == e - s
            if k:
                assert got[k - 1][1] - s == o and s > got[k - 1][0] and e > got[k - 1][1]
                assert o == share if not reach_back else share <= o <= 2 * share


def test_boundaries():
    text = "One two three. Four five six seven.\n\nEight nine ten. Eleven twelve"
    got = [text[a:b] for _, _, a, b, _ in cut(text, 9, 0)]
    assert got == ["One two three. Four five six seven.", "Eight nine ten. Eleven twelve"]
    long = "One two three. " * 10
    back = cut(long, 12, 4)
    assert all(long[a : a + 3] == "One" and long[b - 1] == "." for _, _, a, b, _ in back) and all(o == 4 for *_, o in back[1:])
    assert any(o > 3 for *_, o in cut(long, 12, 3, True)[1:]) and all(o == 3 for *_, o in cut(long, 12, 3)[1:])


def test_one_tokenizer(spark):
    """Controls that one engine takes for white space and another doesn't, and letters that one engine doesn't know yet."""
    rows = [(1, "a\x1fb\x1fc", "x"), (2, "a\x1cb\x1dc\x1ed", "x"), (3, "\u00a0a\u2003b\u3000c\u0085d ", "x"), (4, "a\u200bb c", "x"), (5, "\U00011f02\U0001e4d0 \U0001e4d1. \U00031350", "x"), (6, "  lead a 1_b ¿?\t", "x")]
    t = docs(spark, rows).select("doc_id", "text", token_rules.token_count(F.col("text")).alias("n"), token_rules.token_chunks(F.col("text")).alias("c")).collect()
    assert {r["doc_id"]: r["n"] for r in t} | {5: None} == {1: 3, 2: 4, 3: 4, 4: 4, 5: None, 6: 4}
    for r in t:
        at = token_rules.spans(r["c"])
        assert len(at) == r["n"] and all(r["text"][a:b] == c.lstrip(token_rules.BLANKS) for (a, b), c in zip(at, r["c"])) and "".join(r["c"]) == r["text"][: at[-1][1]]
    rules = spark.createDataFrame([("x", 2, 0, 7)], RULES)
    got = splitting.pieces(docs(spark, rows), rules).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in t if r["n"] > 2} and all(r["n_pieces"] > 1 and r["tokens"] <= 2 for r in got)


def test_pieces_of_tables(spark):
    rows = [(1, "a b c d e", " X\t"), (2, "a b", "x"), (3, None, "x"), (4, "", "x"), (5, "a b c d e", None), (6, "a b c d e", "unknown"), (7, "a b c d e", "y"), (8, "a b c d e", "z"), (9, "a  b c\n_ d..e", "x")]
    rules = spark.createDataFrame([("X", 3, 1, 7), ("x ", 4, 1, 7), ("y", None, 1, 7), ("z", 0, None, 7), (None, 1, 1, 7)], RULES)
    got = splitting.pieces(docs(spark, rows), rules).collect()
    assert {r["doc_id"] for r in got} == {1, 9} and all(r["tokens"] <= 3 for r in got)
    assert [r["text"] for r in got if r["doc_id"] == 1] == ["a b c", "c d e"]
    assert splitting.pieces(docs(spark, []), rules).count() == 0 and splitting.pieces(docs(spark, rows), spark.createDataFrame([], RULES)).count() == 0

"""Brute force, exact round trips and held-out accuracy for the corpus operators, on small tables with odd rows."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vigilspark.llm import (
    binary_output,
    bitmaps,
    bpe,
    components,
    exact_dedup,
    maxscore,
    mixing,
    ngram_join,
    ranks,
    sharding,
    substring_dedup,
    toxicity,
    url_filter,
    workers,
)
from vigilspark.llm.words import Words, sliding_min

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def few_files(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def corpus() -> list[tuple]:
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared, long = say(60), say(3000)
    texts = [None, "", " \t\n", "one", "One", "a b c d", "A b  c d", say(80), long, long + " end", long.replace(" ", "\n", 5)]
    texts += [f"{say(20)} {shared} {say(20)}" for _ in range(6)] + [shared + " " + say(2)] * 2
    base = say(120).split()
    for _ in range(12):  # near copies
        copy = list(base)
        copy[rng.randrange(len(copy))] = "changed"
        texts.append(" ".join(copy))
    texts += ["x " * 200, "x\x1fy x\x1fy ab\x85c", "<|endoftext|> it's 2ΣΣ!"]
    rows = [(i * 3, t, ["en", "de", None][i % 3], None if i == 4 else f"src{i % 2}", 1) for i, t in enumerate(texts)]
    return rows + [rows[7], rows[7], (None, "no id", "en", "src0", 5), (None, None, None, None, None), (rows[9][0], "same id, other text", "en", "src1", 3)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def words(text):
    return WORD.findall(text or "")


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_word_hashes_depend_on_words_alone():
    a = Words(["a b c d", None, "x a b c"])
    h = a.windows(3)
    assert h[0] == h[5] and len({*h.tolist()}) == 5
    assert Words(["a  b\tc\n"]).windows(3)[0] == h[0] != Words(["A b c"]).windows(3)[0] == Words(["A b c", "q"]).windows(3)[0]
    x = np.random.default_rng(1).integers(0, 99, 50)
    assert sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(44)]


@pytest.mark.parametrize("length", [35, 8])
def test_substring_dedup(docs, none, length):
    seen = collections.Counter(tuple(w[i : i + length]) for w in (words(r[1]) for r in ROWS) for i in range(len(w) - length + 1))
    want = []
    for r in ROWS:
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        want.append((r[0], len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    got = substring_dedup.remove_repeats(docs.withColumn("begin", F.lit(1)), length=length)
    assert counted(got.drop("spans").collect()) == counted(want)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_of_texts_with_one_id_and_one_short_hash(spark):
    """Two texts of one id that share 32 bits of a hash keep their own spans."""
    passage = " ".join(f"p{i}" for i in range(40))
    a, b = f"{passage} t10197", " ".join(f"q{i}" for i in range(40)) + " u112163"
    docs = spark.createDataFrame([(1, a), (1, b), (2, f"{passage} end")], "doc_id long, text string")
    assert docs.filter("doc_id = 1").select(F.hash("text")).distinct().count() == 1
    got = substring_dedup.remove_repeats(docs).select("doc_id", "kept", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(1, b, 0), (1, "t10197", 40), (2, "end", 40)]


def toxic_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(["the", "tree", "runs", "over", "green", "fields", "slowly"]) + rng.choice(["", "s", "ed"]) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                text[rng.randrange(40)] = "vilzo" + rng.choice("abcdefghij")
        rows.append((i, " ".join(text), None, None, 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (None, None, None, None, 1), (7777, "", "x", "y", 1), rows[0]], COLUMNS)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, marks).collect()
    assert len(got) == len(rows) + 3
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 100
    odd = [r.score for r in got if not r.text]
    assert len(odd) == 2 and all(0 <= s < 0.5 for s in odd)


def test_toxicity_workers_gather_few_words(monkeypatch):
    """Batches of many words are handed on in parts, and sums over the parts are those of the whole."""
    monkeypatch.setattr(toxicity, "GATHERED", 100)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(20)) for _ in range(400)]
    labels = [i % 2 for i in range(400)]
    most = 100 + 50 * 20
    vocabulary = [b.column("word").to_pylist() for b in toxicity._vocabulary(iter([pa.RecordBatch.from_pydict({"text": texts})]))]
    assert max(map(len, vocabulary)) <= most and set().union(*vocabulary) == set(" ".join(texts).split())
    want = [collections.Counter(w for t, c in zip(texts, labels) if c == side for w in set(t.split())) for side in (0, 1)]
    distinct = [" ".join(set(t.split())) for t in texts]
    counted = [*toxicity._words(iter([pa.RecordBatch.from_pydict({"words": distinct, "toxic": labels})]))]
    got = [collections.Counter(), collections.Counter()]
    for b in counted:
        for x, n0, n1 in zip(*(b.column(c).to_pylist() for c in ("x", "n0", "n1"))):
            got[0][x] += n0
            got[1][x] += n1
    assert len(counted) > 1 and max(b.num_rows for b in counted) <= most and [+g for g in got] == want


def test_decoding_needs_no_encoder(monkeypatch):
    content = open(VOCAB).read()
    monkeypatch.setattr(bpe, "_CODECS", {})
    ids = bpe.Codec(content).encode("Some words, <|endoftext|> and ünïcode.")
    assert not bpe._CODECS and not isinstance(bpe.decoder(content), bpe.Codec)
    assert bpe.decoder(content).tokens.join(ids) == bpe.Codec(content).tokens.join(ids)


def test_workers_keep_no_encoder(spark):
    """Workers go on to other stages; an encoder that each of them keeps takes the memory of those."""

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe._CODECS)] * batch.num_rows})

    texts = spark.range(0, 64, 1, 8).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    assert bpe.encode(texts, VOCAB).filter("size(ids) > 0").count() == 64
    assert {r.n for r in spark.range(0, 64, 1, 32).mapInArrow(held, "n long").collect()} == {0}


def test_lean_scans_release_memory_once_done(monkeypatch):
    batches, released = [pa.RecordBatch.from_pydict({"n": [1]})] * 2, []
    monkeypatch.setattr(workers, "release", lambda: released.append(1))
    scan = workers.lean(lambda rows: (b for b in rows))(iter(batches))
    assert next(scan) == batches[0] and not released
    assert [*scan] == batches[1:] and released == [1]
    with pytest.raises(ZeroDivisionError):
        [*workers.lean(lambda rows: (1 / 0 for _ in rows))(iter(batches))]
    assert released == [1, 1]


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.5 for r in toxicity.judge(docs, none).select("score").collect())


def test_toxicity_ratios_as_tables(spark):
    """Spark's ratios equal those of the definition, single counts included."""
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(6))) for i in range(60)]
    known = spark.createDataFrame([(i, i % 2, 1 + i % 3) for i in range(40)], "doc_id long, toxic int, fold int")
    docs = spark.createDataFrame([*rows, (None, "zz"), (3, None), (50, "xyz")], "doc_id long, text string")
    counts = collections.defaultdict(lambda: [0, 0])
    for i, text in rows[:40]:
        for word in set(text.split()):
            for gram in toxicity.ngrams(word):
                counts[gram][i % 2] += 1
    grams = toxicity.count(docs, known)
    assert {r.x: [r.n0, r.n1] for r in grams.collect()} == counts
    model = toxicity.estimate({g: tuple(n) for g, n in counts.items()})
    ngram, context = toxicity.ratios(grams)
    assert {r.x: r.ratio for r in ngram.collect()} == pytest.approx(model.ngram)
    assert {r.h: r.ratio for r in context.collect()} == pytest.approx(model.context)
    words = {w for _, text in rows for w in text.split()} | {"xyz", "zz"}
    want = {w: model.ratio(w) for w in words}
    table = spark.createDataFrame([(w,) for w in words], "word string")
    for least, at_hand in ((-1000.0, 30), (-1000.0, 0), (0.2, 30), (0.2, 0), (0.2, 100_000)):
        got = {r.word: r.ratio for r in toxicity.word_ratios(table, grams, least, at_hand).collect()}
        assert got == pytest.approx({w: x for w, x in want.items() if x > least}, abs=1e-9) and got


def test_toxicity_word_of_one_document(spark):
    """A toxic word that one labelled document holds once counts in a text that is not labelled."""
    ordinary = ["lamp", "river", "stone", "table", "garden", "window", "paper", "summer"]
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(ordinary) for _ in range(n))
    ids = lambda *folds: [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 in folds]
    learn, four = ids(1, 2, 3), ids(4)
    rows = [(i, say(8), 0) for i in learn[:300]] + [(i, f"{say(7)} qxvzqk", 1) for i in learn[300:301]]
    rows += [(i, f"{say(7)} kjhwxq", 1) for i in learn[301:340]]
    rows += [(i, say(8), 0) for i in four[:60]] + [(i, f"{say(7)} kjhwxq", 1) for i in four[60:90]]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, f"{say(7)} qxvzqk"), (9002, say(8))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.judge(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")).collect()}
    assert got[9001] >= 0.5 > got[9002]


@pytest.mark.parametrize("missing", [0, 1])
def test_toxicity_fold_4_of_one_class(spark, missing):
    """Texts without toxic words score below 0.5, those with one above."""
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (None, None, None, None, 1), (7777, "", "x", "y", 1)], COLUMNS)
    marks = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 != 4 or x[2] != missing]
    got = toxicity.judge(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + 2
    assert all((r.score >= 0.5) == ("vilzo" in (r.text or "")) for r in got)


def test_toxicity_rare_class_in_fold_4(spark):
    """The sample of fold 4 holds both classes, however small it is and rare one of them."""
    rows, labels = toxic_rows()
    four = sorted((x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 4), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest())
    late = [x[0] for x in four if x[2]][-3:]  # the only toxic rows left in it, all behind the first rows
    marks = [x for x in labels if x not in four or not x[2] or x[0] in late]
    docs = spark.createDataFrame(rows, COLUMNS)
    known = spark.createDataFrame([(i, t, zlib.crc32(str(i).encode()) % 5) for i, _, t in marks], "doc_id long, toxic int, fold int")
    found = toxicity.margins(docs, toxicity.count(docs, known))
    weight, intercept, _ = toxicity.fit(docs, known, found, max_rows=5)
    assert (weight, intercept) != (1.0, toxicity.ALONE) and weight > 0 > intercept


def test_toxicity_probabilities_add_up():
    """In each class the characters after a context, listed or not, have probability one."""
    rng = random.Random(2)
    counts = {}
    for _ in range(300):
        for g in toxicity.ngrams("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7)))):
            n = counts.get(g, (0, 0))
            counts[g] = (n[0] + rng.randrange(3), n[1] + rng.randrange(2))
    counts = {g: n for g, n in counts.items() if sum(n) > 1}
    model = toxicity.estimate(counts)
    assert set(model.ngram) == set(counts) and all(np.isfinite(x) for x in model.ngram.values())
    assert toxicity.estimate({g: (b, a) for g, (a, b) in counts.items()}).ngram == pytest.approx({g: -x for g, x in model.ngram.items()})


def sets_of(rows):
    out = []
    for r in rows:
        w = words((r[1] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def groups_of(sets):
    at = list(range(len(sets)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]:
                at[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_ngram_join(docs, none):
    sets = sets_of(ROWS)
    group = groups_of(sets)
    least = {}
    for g, r in zip(group, ROWS):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    want = [(r[0], len(s), least[g]) for r, s, g in zip(ROWS, sets, group)]
    got = ngram_join.near_duplicates(docs)
    assert counted(got.select("doc_id", "n_shingles", "component_id").collect()) == counted(want)
    kept = ngram_join.keep_one(docs).collect()
    no_words = sum(not s for s in sets)
    assert len(kept) == len({g for g, s in zip(group, sets) if s}) + no_words
    assert ngram_join.near_duplicates(none).count() == 0 == ngram_join.keep_one(none).count()


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.comp for r in got} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_dedup(docs, none, block):
    bare = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[bare(r[1])].append(r)
    want = []
    for t, rows in groups.items():
        first = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        kept = 0
        for r in rows:
            stays = not kept and r[0] == first[0] and len(r[1] or "") == len(first[1] or "")
            kept += stays
            want.append((r[0], first[0], len(rows), stays, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.duplicates(docs, block=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert counted(got.collect()) == counted(want)
    kept = exact_dedup.keep_first(docs, block=block)
    assert kept.columns == docs.columns and counted(bare(r.text) for r in kept.collect()) == counted(groups)
    assert exact_dedup.duplicates(none).count() == 0 == exact_dedup.keep_first(none).count()


def test_exact_dedup_of_one_id_and_long_texts(spark):
    """Texts of one id that differ in white space alone are one group, whatever their length and number of blocks."""
    long = "".join(random.Random(1).choices("abc def", k=9_000))
    rows = [(1, long), (1, long.replace(" ", "  ", 1)), (1, long.replace(" ", "\t", 1)), (None, long + "x"), (None, long + " x"), (None, long + "x"), (2, "a b"), (2, "a\tb")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (4096, 700):
        got = exact_dedup.duplicates(df, block=block).collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in got) == [(0, 0, 3)] * 3 + [(1, 1, 3)] * 3 + [(2, 2, 2)] * 2
        assert collections.Counter(r.doc_id for r in got if r.kept) == collections.Counter([None, 1, 2])
        kept = exact_dedup.keep_first(df, block=block).collect()
        assert sorted((r.doc_id or 0, len(r.text)) for r in kept) == [(0, 9_002), (1, 9_001), (2, 3)]


def test_exact_dedup_with_clashing_names(spark):
    """All names that the operator uses itself are columns of the table."""
    names = ["_length", "_digest", "_at", "_id", "_n", "_sha", "row", "id", "raw", "copies", "kept", "stay", "n_chars", "text_sha256", "name", "key"]
    rows = [(i, "same text" if i < 3 else f"text {i}", *[f"{c}{i}" for c in names]) for i in range(6)] * 2
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and counted(map(tuple, kept.collect())) == counted([rows[0], *rows[3:6]])


def test_places_of_rows_without_ids_spread(spark):
    rows = spark.range(4_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    cells = rows.groupBy(F.substring(ranks.seeded(7, F.col("doc_id"), F.xxhash64("text")), 1, 2)).count().agg(F.count("*"), F.max("count")).first()
    assert cells[0] == 256 and cells[1] < 60


def test_budgets_go_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 10), ("d0", "en", "b", 1000), ("d0", "de", "a", 1000), ("d1", "en", "a", 1000), (None, "en", None, 0)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {tuple(r)[:3]: r.budget for r in mixing.budgets(df, (1, 2), 1, {}).collect()}
    # 1505 tokens: d0 and d1 752 each, 1 lost by rounding; in d0 en and de 376; in en a is full and b takes the rest
    assert got == {("d0", "en", "a"): 10, ("d0", "en", "b"): 366, ("d0", "de", "a"): 376, ("d1", "en", "a"): 752, (None, "en", None): 0}


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    leaves = collections.defaultdict(list)
    for r in got:
        leaves[r.domain, r.lang, r.source].append(r)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.copies for r in got) <= 4 * total // 5
    for rows in leaves.values():
        held, budget = sum(r.tokens for r in rows), rows[0].budget
        assert sum(r.tokens * r.copies for r in rows) <= budget <= 2 * held
        left = [r for r in rows if r.copies == min(x.copies for x in rows)]
        assert max(r.copies for r in rows) - min(r.copies for r in rows) <= 1
        if len({r.copies for r in rows}) == 2:  # the row after the prefix does not fit
            assert sum(r.tokens * r.copies for r in rows) + max(r.tokens for r in left) > budget
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == 0 == mixing.take(none).count()


def test_sharding(docs, none):
    got = sharding.interleave(docs, 4).collect()
    assert counted((r.doc_id, r.size, r.text_crc32) for r in got) == counted(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in ROWS
    )
    sizes = collections.Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == [0, 1, 2, 3]
    by_source = collections.Counter(r.source for r in got)
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
        for source, m in by_source.items():
            assert m // 4 - 1 <= sum(r.source == source for r in got if r.shard == s) <= -(-m // 4) + 1
    assert sharding.interleave(none).count() == 0


def test_running_sums(spark):
    rows = [(g, i, i % 5) for g in ("a", None) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i long, v long").withColumn("place", ranks.seeded(1, F.col("i"), F.xxhash64("g")))
    got = ranks.running(df, ["g"], "place", ["i"], F.col("v"), "end", digits=1).collect()
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.place):
            total += r.v
            assert (r.end, r.end_all) == (total, 400)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCAB)


def test_bpe_equals_the_library(docs, none, library):
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r[0], len(ids), digest(" ".join(map(str, ids))), digest(back)))
    assert counted(bpe.round_trip(docs, VOCAB).collect()) == counted(want)
    assert bpe.round_trip(none, VOCAB).count() == 0


def test_bpe_on_random_strings(library):
    codec = bpe.Codec(open(VOCAB, encoding="utf-8").read())
    rng = random.Random(1)
    letters = "aaabbcdethinsr'slvedmlt  \t\n\x0b\x1c\x1f\x85\xa0 　ΣσςİıßéÉé日本語12٣½!?.-_<|>\U0001f600‍­﻿\x00ǅᾳK"
    for k in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30))) + "<|endoftext|>x" * (k % 7 == 0)
        ids = codec.encode(text)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert codec.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_binary_files(spark, docs, none, library, tmp_path):
    manifest = binary_output.write_ids(docs, f"file://{tmp_path}", VOCAB, frame_ids=50)
    got = sorted(binary_output.read_ids(manifest).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    ends = np.cumsum([len(r.ids) for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    want = counted((r[0], *library.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in ROWS)
    assert counted((r.doc_id, *r.ids) for r in got) == want
    some = binary_output.read_documents(manifest, [15, 24]).collect()
    assert counted((r.doc_id, *r.ids) for r in some) == collections.Counter({k: n for k, n in want.items() if k[0] in (15, 24)})
    empty = binary_output.write_ids(none, f"file://{tmp_path}", VOCAB)
    assert binary_output.read_ids(empty).count() == 0


def test_frames_are_independent_and_checked():
    out = io.BytesIO()
    writer = binary_output.Writer(out, 2, frame_ids=20)
    for i in range(9):
        writer.add(i, np.arange(i, dtype="<u2").tobytes())
    writer.close()
    raw = bytearray(out.getvalue())
    reader = binary_output.Reader(io.BytesIO(raw), len(raw), 2)
    assert [x.tolist() for _, x in reader.documents(np.array([7]))] == [list(range(7))]
    import zstandard

    assert len(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(raw))) > 0  # a plain reader can read it
    at = len(raw) - 9 - 12 * len(reader.table)
    raw[at + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError, match="checksum"):
        list(binary_output.Reader(io.BytesIO(raw), len(raw), 2).documents())


def test_url_filter(spark):
    urls = ["https://a.example.org/es/1", "https://example.org/en/12?x=1", "HTTP://Sub.EXAMPLE.com/fr/a#b/c", "http://example.com/de", None, "", "no scheme/",
            "http://x.org", "http://notorg/", "https://b.com/de/1?u=http://c.org/", "https://k.net/x"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"https://s{i % 7}.example.{'org/es' if i % 2 else 'com/fr'}/{i}") for i in range(60)]
    rows += [(0, urls[0]), (None, urls[1])]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows) and all(r.verdict in ("allow", "block") for r in got)
    want = {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"),
            2: ("sub.example.com", "/fr/a", "com/fr/", "allow"), 3: ("example.com", "/de", None), 4: ("", "", None), 5: ("", "", None), 6: ("", "", None),
            7: ("x.org", "", None), 8: ("notorg", "/", None), 9: ("b.com", "/de/1", "com/de/", "block"), 10: ("k.net", "/x", None)}
    for r in got:
        if r.page_id in want:
            assert (r.host, r.path, r.rule, r.verdict)[: len(want[r.page_id])] == want[r.page_id]
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0


def test_url_model_learns_what_its_features_show(spark):
    rng = random.Random(4)
    rows = [(i, "https://" + ("".join(rng.choice("0123456789") for _ in range(20)) if i % 2 else "plain") + f".net/{i}", i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = url_filter.judge(df.select("page_id", "url"), df.filter("page_id < 120").select("url", "label"), rules=()).collect()
    held = [r for r in got if r.page_id >= 120]
    assert sum((r.verdict == "block") == bool(r.page_id % 2) for r in held) >= 0.95 * len(held)


def test_url_sample_is_taken_of_each_class(spark):
    """One allowed URL in 300 rows and 30 blocked ones, with a bound of 20 a class: the model still tells them apart."""
    rows = [(i, "https://plain.net/a", 0) for i in range(300)] + [(300 + i, f"https://x{i}{i * 7919 % 10**6:06d}.net/?a={i}&b={i}", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = url_filter.judge(df.select("page_id", "url"), df.select("url", "label"), rules=(), max_labelled=20).collect()
    assert len(got) == 330 and all((r.verdict == "block") == (r.page_id >= 300) for r in got)


def test_near_copies_just_below_the_threshold_are_not_all_compared(spark, monkeypatch):
    """Copies of one text with five words changed in each, 0.71 alike: few of all pairs are looked at, and links among
    them and to the last, one of them with a word more, are found."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for copy in range(40):
        at = {60 * part + 5 * rng.randrange(11) + 2 for part in range(5)}
        texts.append(" ".join(f"x{copy}" if i in at else w for i, w in enumerate(base)))
    rows = [(i + 7, t, "en", "s", 1) for i, t in enumerate([*texts, texts[20] + " more"])]
    seen = []
    links = ngram_join._links
    monkeypatch.setattr(ngram_join, "_links", lambda pairs, *a: seen.append(pairs.count()) or links(pairs, *a))
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    group = groups_of(sets_of(rows))
    assert got == {r[0]: rows[group.index(g)][0] for r, g in zip(rows, group)} and 20 < len(set(group)) <= 40
    assert sum(seen) < 41 * 40 // 2 // 3


def test_short_lists_are_done_before_the_last_round(spark, monkeypatch):
    """Five holders of a passage, not alike, have all met each other after the second round; six and two near copies
    still get the right groups from the last one."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    own = lambda n: " ".join(word() for _ in range(n))
    few, many, near = own(70), own(70), own(15)
    rows = [(i, f"{few} {own(15)}", "en", "s", 1) for i in range(5)]
    seen = []
    extremes = ngram_join._extremes
    monkeypatch.setattr(ngram_join, "_extremes", lambda entries: seen.append(entries.count()) or extremes(entries))
    groups = lambda rows: {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert groups(rows) == {i: i for i in range(5)} and seen == [0]
    rows += [(10 + i, f"{many} {own(15)}", "en", "s", 1) for i in range(9)] + [(30, f"{many} {near}", "en", "s", 1), (31, f"{many} {near} x", "en", "s", 1)]
    assert groups(rows) == {r[0]: min(r[0], 30) for r in rows} and seen[1] > 0


def test_prefixes_spread_over_the_bitmap():
    """Shingles that the sketch finds rare take as many of the bitmap's slots as others would."""
    rng = np.random.default_rng(3)
    texts = [" ".join(map(str, rng.integers(0, 2**62, 500))) for _ in range(2000)]
    counts = np.zeros(1 << ngram_join.SKETCH_BITS, dtype=np.int64)
    for batch in ngram_join._sketch(1)(iter([pa.record_batch({"text": texts})])):
        counts[batch.column("slot").to_numpy()] += batch.column("n").to_numpy()
    prefixes = np.concatenate([ngram_join._prefix(s, counts) for s in ngram_join.shingle_sets(texts, 1)])
    slots = 1 << ngram_join.SKETCH_BITS
    taken = len(np.unique(bitmaps.slots(prefixes, ngram_join.SKETCH_BITS)))
    assert taken > 0.95 * slots * (1 - np.exp(-len(prefixes) / slots))


def test_lists_of_two_are_not_written(spark, monkeypatch):
    """Two holders of each passage: one row of each pair that may be similar is written, with numbers as nodes."""
    rng = random.Random(9)
    own = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passages = [own(70) for _ in range(6)]
    rows = [(i, f"{passages[i // 2]} {own(15)}", "en", "s", 1) for i in range(12)]
    rows += [(20, f"{passages[0]} {own(1)}", "en", "s", 1), (21, f"{passages[0]} {own(1)}", "en", "s", 1)]
    seen, write = [], ngram_join.materialize

    def written(df):
        out = write(df)
        if {"node", "token", "place"} <= set(out.columns):
            seen.append((dict(out.dtypes)["node"], out.groupBy("token").count().filter("count = 2").count(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "materialize", written)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, COLUMNS)).collect()}
    group = groups_of(sets_of(rows))
    assert got == {r[0]: rows[group.index(g)][0] for r, g in zip(rows, group)}
    assert {kind for kind, _, _ in seen} == {"bigint"} and seen[0][1] == 0 < seen[0][2]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 900):
        a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * 2) for _ in range(2))
        b = np.union1d(b[: n // 6], a[n // 9 :])
        differ = ngram_join._parities(a) ^ ngram_join._parities(b)
        assert len(differ) == len(ngram_join.WORDS) and sum(bin(x & (2**64 - 1)).count("1") for x in differ.tolist()) <= len(np.setxor1d(a, b))


def test_encoder_asks_for_words_of_letters_together(monkeypatch):
    """Words between punctuation, marks, words that change length in lower case and special tokens: as the library
    encodes the whole text, with a small cache as well; plain words are not asked for one by one."""
    content = open(VOCAB).read()
    library = Tokenizer.from_str(content)
    rng = random.Random(5)
    letters = "abXYzéßİΣςµÅ가ᄀ漢अ्क\u0338\u0301'’st,.;:!?()<>|\"#-_=/\\01½\u00ad\u200d😀\u0085\u2028"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(6000)]
    words += ["don't", "'s", "(it's)", "<|endoftext|>", "<|endoftext|>.", "<|startoftext|", "</w>", "foo</w>,", "(foo),", "fooİ,", "İİ", "'re"] * 3
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 25]) for i in range(0, len(words), 25)]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert [*map(binary_output.LibraryEncoder(content).encode, texts)] == want
    monkeypatch.setattr(binary_output, "WORDS_KEPT", 40)
    assert [*map(binary_output.LibraryEncoder(content).encode, texts)] == want
    encoder = binary_output.LibraryEncoder(content)
    asked = []
    one_by_one = encoder._ask
    monkeypatch.setattr(encoder, "_ask", lambda some: asked.extend(some) or one_by_one(some))
    encoder.encode("some words, (between) marks, some more.")
    assert sorted(asked) == ["(", ")", ",", "."]


def test_top_k(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-9, 9, 12).tolist()) for i in range(300)] + [(500 + i, [3] * 12) for i in range(20)]
    vectors += [(600, None), (None, [1] * 12), (601, [5, 5]), (50, [9] * 12)]
    vectors += [(100, [2] * 12), (100, [2] * 12), (7, vectors[7][1])]  # rows and ids that repeat
    df = maxscore.numbered(spark.createDataFrame(vectors, "vec_id long, vector array<long>").repartition(3))
    queries = df.filter("vec_id % 50 = 0")
    old = maxscore.SHARD, maxscore.QUERIES
    maxscore.SHARD, maxscore.QUERIES = 64, 3
    try:
        got = maxscore.search(df, queries, 5).collect()
        empty = maxscore.search(df.filter("false"), queries.filter("false")).count()
    finally:
        maxscore.SHARD, maxscore.QUERIES = old
    assert empty == 0
    usable = [(i, np.pad(v, (0, 12 - len(v)))) for i, v in vectors if i is not None and v is not None]
    want = collections.Counter()
    for at, (q, v) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for n, (i, w) in enumerate(usable) if n != at)[:5]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert counted(got) == want


def test_top_k_when_tasks_are_not_joined(spark):
    """Shards and query blocks meet whatever partitions their numbers fall into."""
    rng = np.random.default_rng(9)
    vectors = [(i, rng.integers(-9, 9, 4).tolist()) for i in range(200)]
    old = maxscore.SHARD, maxscore.QUERIES
    maxscore.SHARD, maxscore.QUERIES = 32, 2
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = maxscore.numbered(spark.createDataFrame(vectors, "vec_id long, vector array<long>").repartition(3))
        got = maxscore.search(df, df.filter("vec_id % 50 = 0"), 5).collect()
    finally:
        maxscore.SHARD, maxscore.QUERIES = old
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = collections.Counter()
    for q, v in vectors[::50]:
        best = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q)[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert counted(got) == want


def test_top_k_of_large_components(spark):
    """Scores beyond 2**53 that differ by less than a double tells apart; a component beyond a long."""
    rows = [(i, [1e6 + (i * 37 % 64) / 256, 250_000.0 + i / 256, -3.5e5 + (i % 5) / 256, (-1) ** i / 256]) for i in range(120)]
    rows += [(500, [0.0, 0.0, 0.0, 0.0]), (501, [0.0, 2.0**60, 0.0, 0.0]), (550, [1 / 256, 0.0, 0.0, 0.0])]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").select("vec_id", maxscore.quantised(F.col("v")).alias("vector"))
    df = maxscore.numbered(df.repartition(3))
    got = maxscore.search(df, df.filter("vec_id IN (500, 550)"), 5).collect()
    near = df.filter("vec_id <> 501")
    got += maxscore.search(near, near.filter("vec_id IN (0, 50, 100)"), 5).collect()
    want = collections.Counter()
    for q in (500, 550, 0, 50, 100):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in whole.items() if i != q and (q >= 500 or i != 501))[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    assert counted(got) == want


def test_quantised(spark):
    rows = [(1, [0.5, -0.001]), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, None), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "i int, v array<float>").select("i", maxscore.quantised(F.col("v")).alias("q"))
    assert {r.i: r.q for r in df.collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None}


def test_top_k_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    df = maxscore.query(spark, SF)
    assert counted(df.collect()) == counted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({maxscore.SQL})").fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force on its own input."""
    rows, labels = toxic_rows()
    more = [(10_000 + (r[0] or 0) + i, *r[1:]) for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows + more, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out/{name}")
        docs = spark.read.parquet(f"{tmp_path}/out/{name}")
        kept.append(docs.collect())
    toxic = {i for i, _, t in labels if t}
    assert sum(r.doc_id not in toxic for r in kept[0]) >= 0.99 * (len(rows) + len(more) - len(toxic))
    assert sum(r.doc_id in toxic for r in kept[0]) <= 0.05 * len(toxic)
    bare = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    assert counted((bare(r),) for r in kept[1]) == counted({(bare(r),) for r in kept[0]})
    sets = sets_of([(r.doc_id, r.text) for r in kept[1]])
    assert len(kept[2]) == len({g for g, s in zip(groups_of(sets), sets) if s}) + sum(not s for s in sets)
    assert {r.doc_id for r in kept[3]} <= {r.doc_id for r in kept[2]} and len(kept[4]) == len(kept[3]) > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept[4])

"""Spelling variants, periodic runs and decontamination against brute force, on small tables with odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from vigilspark.llm import decontamination, periodic_runs, spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RUN = re.compile("[A-Za-zÀ-ÿ]+")
COLUMNS = "doc_id long, text string, lang string, word string, n long, shard string, runs string, spans int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(autouse=True)
def few_files(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def table(spark, texts, ids=None):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i if ids is None else ids[i], t, "en", "w", i, "s", "r", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def stored(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


# -- op11 -------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return out


def vocabulary(seed, size, alphabet="abcé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 7))) for _ in range(size)}
    for w in list(words)[: size // 3]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :] or "q", w[:i] + rng.choice(alphabet) + w[i:], w[:i] + "z" + w[i + 1 :]}
    return {w: rng.choice([1, 2, 5, 11, 30, 200, 1000]) for w in sorted(words)}


@pytest.mark.parametrize("sample,leaf", [(1 << 16, 4096), (1 << 16, 4), (20, 8), (0, 16)])
def test_variants_equal_all_pairs(spark, sample, leaf):
    """With tiny leaves, slices and samples the upper planes and the slices do the work; nothing changes."""
    counts = vocabulary(leaf, 150) | {"x" * 500: 7, "x" * 501: 70, "x" * 250 + "y" + "x" * 250: 700, "\U0001f600é": 3, "\U0001f600e": 100}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = spelling.variants(df, sample=sample, leaf=leaf).collect()
    assert {tuple(r) for r in got} == expected_variants(counts) and len(got) == len(counts)


def test_anagrams_share_a_point(spark):
    counts = {"".join(p): 1 for p in itertools.permutations("abcdef")}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = spelling.variants(df, leaf=50).collect()
    assert len(got) == 720 and {r["n_near"] for r in got} == {0}


def expected_words(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def test_spelling_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    words = ["Station", "Stations", "station", "stetion", "ÉTAGES", "étages", "étagés", "x×y÷zabc", "short", "window", "windows"]
    texts = [None, "", " ", "123 456"] + [" ".join(rng.choice(words) for _ in range(200)) + ".-," for _ in range(60)] + ["a" * 300_000 + " " + "window " * 9]
    ids = [*range(len(texts) - 3), None, None, 7]
    rows = list(zip(ids, texts))
    got = spelling.query(spark, stored(table(spark, texts, ids), tmp_path)).collect()
    assert {tuple(r) for r in got} == expected_variants(expected_words(rows)) and len(got) > 6


def test_spelling_of_nothing(spark, tmp_path):
    assert spelling.query(spark, stored(table(spark, []), tmp_path / "a")).count() == 0
    assert spelling.query(spark, stored(table(spark, [None, "few words"]), tmp_path / "b")).count() == 0


# -- op12 -------------------------------------------------------------------------


def expected_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def periodic(rng):
    k = rng.randrange(1, 6)
    words = [rng.randrange(k if rng.random() < 0.6 else 50) for _ in range(rng.randrange(120))]
    for _ in range(rng.randrange(4)):
        unit = [rng.randrange(k) for _ in range(rng.randrange(1, 40))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = list(itertools.islice(itertools.cycle(unit), rng.randrange(len(unit), 5 * len(unit) + 1)))
    return words


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(150):
        texts = [periodic(rng) for _ in range(rng.randrange(1, 7))]
        words, counts = np.array([w for t in texts for w in t], dtype=np.int64), np.array([len(t) for t in texts])
        got = [(t, a, b - a, q) for t, a, b, q in periodic_runs.find(words, counts)]
        assert got == [(t, *run) for t, words_ in enumerate(texts) for run in expected_runs(words_)]


def test_sums_of_squares_are_exact():
    rng = np.random.default_rng(2)
    for width, length in ((2, 7), (4, 11), (16, 47), (64, 191)):
        top = int(((periodic_runs.PRIME - 1) // width) ** 0.5)
        a, b = (rng.integers(0, top + 1, (n, 3)).astype(np.uint64) for n in (width, length))
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(a[:, c], b[d : d + width, c])) for c in range(3)] for d in range(length - width + 1)]
        assert periodic_runs.mismatches(a, b).tolist() == want


def test_words_folded_to_one_number_are_told_apart():
    """Numbers that differ by the fold of the smallest scale make seeds, but no runs."""
    fold = int(((periodic_runs.PRIME - 1) // 2) ** 0.5)
    words = np.array([1, 2, 1 + fold, 2 + fold] * 2 + [5] + [3 + fold * (i % 2) for i in range(12)], dtype=np.int64)
    assert periodic_runs.find(words, np.array([len(words)])) == [(0, 9, 21, 2)]


def test_long_texts_end():
    """Texts of hundreds of thousands of words with one period each."""
    for q in (1, 7, 60_000):
        words = np.arange(300_000) % q
        assert periodic_runs.find(words, np.array([len(words)])) == [(0, 0, 300_000, q)]


def planted(doc, words):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(len(words))]


def test_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", " \t\n"] + [" ".join(f"w{x}é" for x in periodic(rng)) for _ in range(60)] + ["x " * 200_000, "a\x1fb " * 30]
    texts += [" ".join(f"v{rng.randrange(300)}" for _ in range(400)) for _ in range(40)]
    ids = [*range(len(texts) - 4), None, None, 5, 5]
    got = periodic_runs.query(spark, stored(table(spark, texts, ids), tmp_path)).collect()
    want = []
    for doc, text in zip(ids, texts):
        words = planted(doc, WORD.findall(text or ""))
        runs = [(0, len(words), 1)] if len(words) == 200_000 else expected_runs(words)
        drop = {i for a, n, q in runs for i in range(a + q, a + n)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
        kept = " ".join(w for i, w in enumerate(words) if i not in drop)
        four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((doc, len(runs), *four, *[hashlib.sha256(x.encode()).hexdigest() for x in (told, kept)]))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert any(r["n_runs"] for r in got) and not all(r["n_runs"] for r in got)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.detect(table(spark, [])).count() == 0


# -- op13 -------------------------------------------------------------------------


def expected_hits(docs, items, width=10):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = TERM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows[tuple(words[i : i + width])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = TERM.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leaks(seed):
    rng = random.Random(seed)
    say = lambda n, k=12: [f"{rng.choice('aBé')}{rng.randrange(k)}" for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([1, 3, 9, 10, 11, 14, 40]), 40))) for i in range(25)]
    items += [(3, items[3][1]), (99, items[5][1]), (None, "No Item-Id here"), (100, None), (101, " .,- "), (2000, "é" * 50)]
    docs = [(0, None), (1, ""), (2, "--- ..."), (None, "no item id HERE no item id here"), (None, None)]
    for i in range(60):
        words = say(rng.randrange(60), 40)
        for _ in range(rng.randrange(3)):
            passage = rng.choice(items)[1] or ""
            at = rng.randrange(len(words) + 1)
            words[at:at] = re.sub(" ", rng.choice([" ", ", ", "\n"]), passage).split(" ")
        docs.append((i + 10, " ".join(words)))
    return docs + [docs[-1], (docs[-2][0], "other text, same id"), (500, docs[-1][1] + " end")], items


@pytest.mark.parametrize("seed,shard_words,block_bytes", [(1, 1 << 20, 1 << 23), (2, 50, 1 << 23), (3, 200, 100), (4, 1, 1 << 23)])
def test_hits_equal_brute_force(spark, seed, shard_words, block_bytes):
    """Shards of one document up to all, and phrases in one block or in many."""
    docs, items = leaks(seed)
    frame = table(spark, [t for _, t in docs], [d for d, _ in docs])
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    shards = decontamination.index(frame, shard_words=shard_words)
    out = decontamination.search(shards, decontamination.pieces(bench), block_bytes=block_bytes).collect()
    got = []
    for r in out:
        spans = [(s["begin"], s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
        names = hashlib.sha256(",".join(r["items"]).encode()).hexdigest()
        got.append((r["doc_id"], r["n_words"], sum(b - a for a, b in spans), len(r["items"]), names, bool(spans)))
    assert sorted(got, key=repr) == expected_hits(docs, items)


def test_decontamination_query(spark, tmp_path):
    docs, items = leaks(7)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = stored(table(spark, [t for _, t in docs], [d for d, _ in docs]), tmp_path)
    rows = decontamination.query(spark, sf).collect()
    assert sorted(map(tuple, rows), key=repr) == expected_hits(docs, items)


def test_long_items_are_cut_into_pieces(spark):
    words = [f"w{i % 5000}" for i in range(9_000)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    cut = [r["words"] for r in decontamination.pieces(bench).collect()]
    assert sorted({tuple(p[i : i + 10]) for p in cut for i in range(len(p) - 9)}) == sorted({tuple(words[i : i + 10]) for i in range(8_991)})
    docs = table(spark, [" ".join(words[4_090:4_110]), " ".join(words[:9]), "x " + " ".join(words)])
    out = {r["doc_id"]: (r["n_words"], [tuple(s) for s in r["spans"]]) for r in decontamination.decontaminate(docs, bench).collect()}
    assert out == {0: (20, [(0, 20)]), 1: (9, []), 2: (9_001, [(1, 9_001)])}


def test_nothing_to_search(spark):
    docs, none = table(spark, ["some words", None]), spark.createDataFrame([], "item_id long, text string")
    assert sorted((r["n_words"], len(r["spans"])) for r in decontamination.decontaminate(docs, none).collect()) == [(0, 0), (2, 0)]
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert decontamination.decontaminate(table(spark, []), some).count() == 0


def test_suffixes_are_sorted():
    rng = random.Random(3)
    for _ in range(60):
        docs = [[rng.randrange(1, 4) for _ in range(rng.randrange(30))] for _ in range(rng.randrange(1, 6))]
        codes = np.array([c for d in docs for c in [*d, 0]], dtype=np.int32)
        symbols = codes.astype(np.int64) + len(docs) - 1
        symbols[codes == 0] = np.arange(len(docs))
        order = decontamination.suffix_array(symbols).tolist()
        assert order == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())
        parts = decontamination.build(codes, 3)
        row = {"lengths": [len(d) for d in docs], "tree": parts["tree"], "zeros": parts["zeros"]}
        assert decontamination._sizes(row, 3).tolist() == [int((codes == k).sum()) for k in (1, 2, 3)]


def test_unique_words_make_many_levels(spark):
    """A vocabulary as large as the shard."""
    text = " ".join(f"u{i}" for i in range(70_000))
    item = spark.createDataFrame([(1, " ".join(f"u{i}" for i in range(65_530, 65_545)))], "item_id long, text string")
    row = decontamination.decontaminate(table(spark, [text]), item).first()
    assert [tuple(s) for s in row["spans"]] == [(65_530, 65_545)]
    assert row["items"] == ["1"]

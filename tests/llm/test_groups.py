"""Operators that relate rows: mixing, packing, line dedup, n-gram join, chat snapshots, neighbours."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import odd
from pyspark.sql import functions as F

from opslens.llm import chat, common, components, lines, mixing, neighbours, ngram_join, packing, queries

SMALL = "/root/testdata/sf0.001"


def test_mix_shares_and_bounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert sorted(r["taken"] for r in rows) == sorted(r["taken"] for r in mixing.mix(docs.repartition(5)).collect())  # reruns agree
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    sizes = {s: sum(r["size"] for r in own) for s, own in by.items()}
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(sorted(sizes))}
    capped = set()
    while True:  # the plain form of sharing out
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s in sizes if s not in capped and weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    for s, own in by.items():
        target = 3 * sizes[s] if s in capped else weights[s] * level
        assert math.isclose(own[0]["target"], target, rel_tol=1e-9)
        assert abs(sum(r["taken"] for r in own) - target) <= sizes[s] / len(own)


def test_mix_caps_small_sources_and_splits_a_hot_one(spark):
    rows = [(i, "w " * (1 + i % 9), "big") for i in range(3000)] + [(9000 + i, "a b c", "aaa") for i in range(3)] + [(9100, "x y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, block=16).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect()
    by = {r["source"]: r for r in found}
    assert by["aaa"]["target"] == 27 and by["aaa"]["t"] == 27 and by[None]["target"] == 6 and by[None]["t"] == 6
    assert abs(by["big"]["t"] - by["big"]["target"]) <= 9


def test_mix_on_odd_rows(spark):
    docs = odd.documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mix(odd.empty(spark)).count() == 0
    again = mixing.repeated(docs)
    assert again.columns == docs.columns
    taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert again.count() == taken


def packed_is_right(spark, docs):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = defaultdict(int)
    for r in docs.collect():
        ids = tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + (1,)
        want[r["doc_id"], ids] += 1
    rows = packing.pack(docs).collect()
    texts = defaultdict(list)
    for doc_id, ids in want:
        texts[doc_id].append(np.array(ids, dtype="<u4"))
    covered = defaultdict(int)
    for r in rows:
        own = [a for a in texts[r["doc_id"]] if len(a) == r["doc_tokens"]
               and zlib.crc32(a[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]]
        assert own
        covered[r["doc_id"]] += r["length"]
    assert covered == {i: sum(len(ids) * n for (j, ids), n in want.items() if j == i) for i, _ in want}
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == packing.LENGTH or at & (at - 1) == 0


def test_packing_round_trip(spark):
    packed_is_right(spark, spark.read.parquet(f"{SMALL}/documents.parquet"))


def test_packing_odd_rows(spark):
    packed_is_right(spark, odd.documents(spark))
    assert packing.pack(odd.empty(spark)).count() == 0


def test_words_alone_give_the_ids_of_the_text():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    own = packing.tokens(packing.tokenizer_path())
    texts = ["It's  a TEST,\twith odd  Ünïcödé... ß ÿ 3.14 <|endoftext|> é İx Σς 日本語 ***a*** x_y 'll", "", "\n\n", "don't we'll I'M", "ÀÉ,é."]
    for text in texts:
        assert list(np.frombuffer(own.encode([text])[0], dtype=own.kind)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_hilbert_neighbours_touch():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    place = packing.hilbert(cells, bits=3)
    assert sorted(place) == list(range(side ** 3))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id")
    want = odd.removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: list(r["removed"]) for r in lines.removed_lines(docs).collect()}
    assert got == want and sum(map(len, want.values())) > 20


def test_a_crowd_of_near_copies_of_a_line(spark):
    r = random.Random(4)
    base = [f"word{i}" for i in range(30)]
    rows = []
    for i in range(400):
        own = list(base)
        for k in r.sample(range(30), r.randrange(0, 4)):
            own[k] = f"other{r.randrange(9)}"
        rows.append((i, " ".join(own) + "\nthe same short line of words"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: list(r["removed"]) for r in lines.removed_lines(docs).collect()} == odd.removed(rows)


def test_a_crowd_of_lines_just_below_the_limit_is_not_paired_up(spark, monkeypatch):
    r = random.Random(8)
    rows = []
    for i in range(900):
        own = [f"word{k}" for k in range(30)]
        for k in r.sample(range(30), 2):
            own[k] = f"other{i}x{k}"
        rows.append((i, " ".join(own)))
    rows += [(600 + i, rows[r.randrange(900)][1] + " more" + " and" * (i % 2)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}

    def counted(df, purpose):
        table = common.written(df, purpose)
        sizes[purpose] = max(sizes.get(purpose, 0), table.count())
        return table

    monkeypatch.setattr(lines, "written", counted)
    assert {r["doc_id"]: list(r["removed"]) for r in lines.removed_lines(docs).collect()} == odd.removed(rows)
    assert max(sizes.values()) < 16 * lines.TRIED * len(rows), sizes  # a line has about 14 keys


def test_line_keys_meet_for_every_similar_pair_and_for_few_others():
    r = np.random.default_rng(5)
    vocabulary = np.sort(r.integers(0, 1 << 63, 900).astype(np.uint64))
    levels = dict(zip(vocabulary.tolist(), r.permutation([*range(90, 150)] * 14 + [20, 40, 60] * 20).tolist(), strict=True))  # most are crowded
    sets = []
    for size in [*r.integers(4, 40, 600), 120, 200]:
        own = r.choice(vocabulary, size, replace=False)
        for changed in (0, 1, size // 9, size // 5):
            other = np.concatenate((own[changed:], r.choice(vocabulary, r.integers(0, changed + 1))))
            sets.append(np.unique(other))
    sets = [s for s in sets if len(s) >= lines.APART]
    words, n = np.concatenate(sets), np.array([len(s) for s in sets])
    line, keys = lines.line_keys(words, np.repeat(np.arange(len(n)), n), n, np.array([levels[w] for w in words.tolist()], dtype=np.uint8))
    assert (np.diff(line) >= 0).all()
    own = [set(k.tolist()) for k in np.split(keys, np.searchsorted(line, np.arange(1, len(n))))]
    whole = [set(s.tolist()) for s in sets]
    similar, met = 0, 0
    for i in range(len(n)):
        for j in range(i):
            if whole[i] != whole[j] and 9 * len(whole[i] & whole[j]) >= 4 * (n[i] + n[j]):
                assert own[i] & own[j]
                similar += 1
            met += bool(own[i] & own[j])
    prefix = [set(sorted(s, key=lambda w: (levels[w], w))[:len(s) - -(-4 * len(s) // 5) + 1]) for s in whole]
    by_one_word = sum(bool(prefix[i] & prefix[j]) for i in range(len(n)) for j in range(i))
    assert similar > 1000 and met < by_one_word / 2, (similar, met, by_one_word)


def test_lines_on_odd_rows(spark):
    docs = odd.documents(spark)
    found = {r["doc_id"]: r for r in lines.removed_lines(docs).collect()}
    assert list(found[2]["removed"]) == [0, 1] and list(found[3]["removed"]) == [] and found[4]["n_lines"] == 0
    left = lines.cleaned(docs)
    ids = [r["doc_id"] for r in left.collect()]
    assert left.columns == docs.columns and 2 not in ids and ids.count(3) == 2 and 4 in ids and None in ids
    assert lines.removed_lines(odd.empty(spark)).count() == 0 and lines.cleaned(odd.empty(spark)).count() == 0


def test_ngram_groups_against_all_pairs(spark):
    r = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randrange(8, 160))]
        for copy in range(r.randrange(1, 9)):
            own = [w if r.random() > 0.01 * copy else r.choice(vocabulary) for w in base]
            rows.append((len(rows), " ".join(own + (passage if family % 2 else []))))
    rows += [(len(rows) + i, t) for i, t in enumerate(["a b", "a b", "a  B", "c", "", None, " "])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.grouped(docs, hot=6).collect()}
    want = odd.near_components(rows)
    assert got == {i: (len(odd.shingles(t)), want[i]) for i, t in rows}


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(2)
    sizes, points, sets = [], [], []
    base = r.integers(0, 1 << 60, 300).astype(np.uint64)
    for i in range(150):
        own = np.unique(np.concatenate((r.permutation(base)[:r.integers(200, 300)], r.integers(0, 1 << 60, r.integers(0, 80)).astype(np.uint64))))
        sets.append(set(own.tolist()))
        sizes.append(len(own))
        points.append(np.bincount((own % np.uint64(ngram_join.GROUPS)).astype(int), minlength=ngram_join.GROUPS))
    found = {tuple(sorted(p)) for p in ngram_join.survivors(np.array(sizes), np.arange(150), np.array(points))}
    linked = {(i, j) for i in range(150) for j in range(i + 1, 150) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked <= found and linked


def test_a_crowd_just_below_the_limit_does_not_pair_up(spark):
    passage = " ".join(f"p{i}" for i in range(126))  # 122 shingles shared; 146 in each, 125.2 needed
    rows = [(i, passage + " " + " ".join(f"o{i}x{k}" for k in range(24))) for i in range(60)]
    rows += [(100, rows[7][1] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = ngram_join.sketches(docs).toArrow()
    n = table["n"].to_numpy()
    pairs = ngram_join.survivors(n, np.arange(len(n)), ngram_join._points(table["counts"], n))
    left = {tuple(sorted((table["doc_id"][i].as_py(), table["doc_id"][j].as_py()))) for i, j in ngram_join.possible(pairs, n, table["counts"])}
    assert len(pairs) > 200 and (7, 100) in left and len(left) < 10
    want = odd.near_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.grouped(docs).collect()} == want


def test_ngram_on_odd_rows(spark):
    docs = odd.documents(spark)
    rows = ngram_join.grouped(docs).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and by[11]["component_id"] == 10 and by[4]["component_id"] == 4 and by[5]["n_shingles"] == 0
    assert by[None]["component_id"] is None
    assert ngram_join.grouped(odd.empty(spark)).count() == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 301), (301, 302), (302, 300)] + [(5, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and all(got[i] == 5 for i in (5, 7, 200, 259)) and got[302] == 300
    assert components.components(frame.limit(0)).count() == 0


CHAT = "conv_id long, turn long, role string, text string, extra string"


def test_snapshots_collapse(spark):
    def conv(i, *texts):
        return [(i, k, "user" if k % 2 == 0 else "assistant", t, "e") for k, t in enumerate(texts)]
    rows = (conv(1, "a", "b") + conv(2, "a", "b", "c") + conv(3, "a", "b", "c") + conv(4, "a") + conv(5, "x", None)
            + conv(6, "x") + conv(6, "x") + [(None, 0, None, "<|im_end|> hi", None), (7, None, "user", "", "e")])
    got = {r["conv_id"]: r for r in chat.render(spark.createDataFrame(rows, CHAT)).collect()}
    assert set(got) == {2, 5, None, 7}
    assert got[2]["n_copies"] == 2 and got[2]["n_turns"] == 3
    assert got[2]["rendered"].startswith("<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb")
    assert got[None]["rendered"] == "<|im_start|>unknown\n< |im_end|> hi<|im_end|>\n"
    assert chat.render(spark.createDataFrame([], CHAT)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string"


def test_neighbours_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
            (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [1.0, 0.0], None), (12, [1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], VECTORS)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.grouped(frame).collect()}
    assert len(got) == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[12] == (3, 1, False) and got[3] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 13))
    assert neighbours.grouped(frame.limit(0)).count() == 0


def test_recall_and_a_crowd(spark):
    r = np.random.default_rng(6)
    crowd = r.normal(size=16)
    rows = [(i, (crowd + 0.05 * r.normal(size=16)).tolist(), 1) for i in range(300)]
    rows += [(300 + i, r.normal(size=16).tolist(), 1 + i % 2) for i in range(600)]
    rows += [(1000 + i, (np.array(rows[300 + i][1]) * 1.01 + 0.02 * r.normal(size=16)).tolist(), rows[300 + i][2]) for i in range(200)]
    frame = spark.createDataFrame([(*row, "x") for row in rows], VECTORS)
    _, _, links = neighbours.edges(frame, block=64)
    found, every = neighbours.audit(frame, links, every=5)
    assert every > 300 and found / every >= 0.99
    x = np.array([row[1] for row in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([row[2] for row in rows])
    close = (x @ x.T >= 0.93) & (same[:, None] == same[None, :])
    np.fill_diagonal(close, False)
    got = {row["vec_id"]: row["n_links"] for row in neighbours.grouped(frame, block=64).collect()}
    assert sum(got[row[0]] for row in rows) >= 0.99 * close.sum() and all(got[row[0]] <= close[i].sum() for i, row in enumerate(rows))


def close_pairs(rows, threshold=0.93):
    """All links of (vec_id, vector, label) rows, by brute force."""
    x = np.array([row[1] for row in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    same = np.array([row[2] for row in rows])
    close = np.triu((x @ x.T >= threshold) & (same[:, None] == same[None, :]), 1)
    return {(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(close), strict=True)}


def test_lone_pairs_of_many_small_leaves(spark):
    r = np.random.default_rng(8)
    rows = [(i, r.normal(size=48).tolist(), 1) for i in range(800)]
    rows += [(1000 + i, (np.array(rows[i][1]) + 0.35 * r.normal(size=48)).tolist(), 1) for i in range(300)]
    want = close_pairs(rows)
    frame = spark.createDataFrame([(*row, "x") for row in rows], VECTORS)
    got = neighbours.grouped(frame, k=2, tables=1, leaf=2).agg(F.sum("n_links")).first()[0]
    assert len(want) > 200 and 0.99 * 2 * len(want) <= got <= 2 * len(want)


def test_crowds_with_links_across_are_compared_whole_when_the_recall_stays_low(spark):
    r = np.random.default_rng(9)
    one = r.normal(size=32)
    two = one + 0.32 * r.normal(size=32)  # members of one crowd fill their lists; many links run between the two
    rows = [(i, ((one, two)[i % 2] + 0.07 * r.normal(size=32)).tolist(), 1) for i in range(400)]
    want = close_pairs(rows)
    across = sum((i + j) % 2 for i, j in want)
    frame = spark.createDataFrame([(*row, "x") for row in rows], VECTORS)
    got = neighbours.grouped(frame, passes=0, leaf=400, recall=1.0).agg(F.sum("n_links")).first()[0]
    assert across > 1000 and got == 2 * len(want)


def test_short_lines_that_are_repeated_go(spark, tmp_path):
    rows = [(1, "And so.\nha ha ha\nyes\none line of its own here"), (2, "and SO.\nha ha\nno\nso and."), (3, "ha\nyes yes yes"), (4, "so. and\n\nyes"), (5, "ha ha ha ha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["removed_lines"]) for r in queries.op6_similar_lines(spark, str(tmp_path)).collect()}
    assert got == {1: (4, 0, ""), 2: (4, 2, "0,1"), 3: (2, 2, "0,1"), 4: (2, 2, "0,2"), 5: (1, 1, "0")}
    left = {r["doc_id"]: list(r["removed"]) for r in lines.removed_lines(docs, least=3).collect()}
    assert left == {1: [], 2: [], 3: [], 4: [], 5: [0]}  # "ha ha ha ha" has four words, though one distinct

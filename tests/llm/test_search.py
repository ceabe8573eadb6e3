"""Decontamination and set join against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.llm.decontaminate import Block, Budget, Index, decontaminated, find_contamination, plain
from folio.llm.near_copies import one_of_each_group
from folio.llm.set_join import Jaccard, block_links, jaccard_components


def least_edits(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for k, b in enumerate(text, 1):
            new.append(min(row[k - 1] + (a != b), row[k] + 1, new[-1] + 1))
        row = new
    return min(row)


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["th", "er", "on", "in", "a", "es", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_blocks_find_what_brute_force_finds():
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randint(6, 40))) for k in range(20)] + [(90, "x y"), (91, ""), (92, "!!")]
    # every length from the first with an edit on
    items += [(100 + n, plain(prose(rng, 20))[:n]) for n in range(8, 42)]
    items = [(i, t) for i, t in items if i < 100 or len(plain(t)) == i - 100]
    index = Index(items, Budget())
    tried = [x for x in items if x[0] < 20 or x[0] >= 100]
    cut = 0
    for _ in range(300):
        k, text = rng.choice(tried)
        p = list(plain(text))
        for _ in range(rng.randint(0, len(p) // 9)):
            at = rng.randrange(len(p))
            p[at : at + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
        doc = plain(f"{prose(rng, rng.randint(0, 30))} {''.join(p)} {prose(rng, rng.randint(0, 30))}")
        got = {i: e for i, _, _, e in index.matches(doc)}
        for i, t in tried:
            size = len(plain(t))
            d, most = least_edits(plain(t), doc), size // 10  # the declared tenth
            assert (got.get(i) == d) if d <= most else (i not in got), (i, d, most, doc)
            cut += 0 < d <= most and size in (*range(10, 16), *range(20, 24), 30, 31)
    assert cut > 10  # lengths that need shorter q-grams were met with edits
    assert [m[0] for m in Index(items[:23], Budget()).matches("so X, Y. end")] == [90]


def test_long_texts_are_searched_in_stretches():
    rng = random.Random(4)
    items = [(k, prose(rng, 30)) for k in range(5)]
    block = Block(items, Budget())
    text = plain(" ".join([prose(rng, 3_000), items[3][1], prose(rng, 3_000), items[1][1]]))
    whole = block.matches(text)
    found = block.bands
    block.bands = lambda hits, slot: found(hits, slot, most_pairs=200)
    assert block.matches(text) == whole and [m[0] for m in whole] == [1, 3]


def test_find_contamination(spark):
    item = "The quick onerth in the ering that thion of the blent and erest of onin."
    docs = spark.createDataFrame(
        [(1, f"Before. {item} After.", "m"), (2, "clean text", "m"), (3, None, "m"), (4, "", "m"), (5, item.upper().replace(" ", "\n"), "m"), (5, item.upper().replace(" ", "\n"), "m"), (None, item, "m"), (6, "long " * 20_000 + item, "m")],
        "doc_id long, text string, item_id string",
    )
    benchmark = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 1), (None, "zzz", 1), (9, "unrelated onerth passage of its own kind here", 1)], "item_id long, text string, matches int")
    for block_chars in (4_000_000, 10):  # one block, one for each item
        b = Budget(block_chars=block_chars)
        got = [(r.doc_id, [m.item_id for m in r.matches]) for r in find_contamination(docs, benchmark, b).collect()]
        assert sorted(got, key=str) == sorted([(1, [7]), (2, []), (3, []), (4, []), (5, [7]), (5, [7]), (None, [7]), (6, [7])], key=str)
        clean = decontaminated(docs.withColumn("matches", F.lit("mine")), benchmark, b)
        assert sorted((r.doc_id, r.matches) for r in clean.collect()) == [(2, "mine"), (3, "mine"), (4, "mine")]
    assert "ArrowEvalPython" not in find_contamination(docs, benchmark, Budget(block_chars=10))._jdf.queryExecution().toString()  # blocks are no chain of workers
    with pytest.raises(ValueError):
        find_contamination(docs.withColumn("Matches", F.lit(1)), benchmark)
    assert decontaminated(docs, benchmark.filter("false")).columns == docs.columns and decontaminated(docs, benchmark.filter("false")).count() == 8
    assert find_contamination(docs.filter("false"), benchmark).count() == 0


def brute(rows, size: int, percent: int):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed: int, groups: int, copies: int) -> list[tuple[int, str | None]]:
    """Groups of near copies of texts, some sharing a passage, some copies exact, ids shuffled."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(25)]
    texts: list[str | None] = [None, "", " \t", "One two", "one TWO", "one two three", "É é", "a b c d e", "A B C D E"]
    for g in range(groups):
        base = [f"w{rng.randrange(60)}g{g if rng.random() < 0.7 else 0}" for _ in range(rng.randint(5, 60))]
        if g % 3 == 0:
            base[3:3] = passage
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                words[rng.randrange(len(words))] = f"e{rng.randrange(1000)}"
            texts.append(" ".join(words))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


@pytest.mark.parametrize(("seed", "j"), [(1, Jaccard()), (2, Jaccard(percent=80, words=5, frequent=2, crowd=3, block=4)), (3, Jaccard(frequent=1, fragments=2, crowd=1, block=2)), (4, Jaccard(percent=50, words=1)), (5, Jaccard(percent=60, words=1, frequent=1, crowd=2, block=3, block_shingles=40))])
def test_components_match_brute_force(spark, seed, j):
    rows = corpus(seed, 14, 12)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, j).collect()}
    assert got == brute(rows, j.words, j.percent)


def test_set_join_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", "s"), (None, "a b c d e f", "s"), (3, None, "s")], "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, None), (3, 0, 3)], key=str)
    assert jaccard_components(docs.filter("false")).count() == 0
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, None, 3], key=str)


def test_block_links_join_all_that_is_linked():
    import pandas as pd

    rows = pd.DataFrame({"i": 0, "j": 1, "node": [1, 2, 3, 4], "n": [4, 4, 4, 4], "component": [1, 2, 3, 4], "block": [0, 1, 0, 1], "shingle": 7, "met": 7, "shingles": [[1, 2, 3, 4], [1, 2, 3, 4], [9, 8, 7, 6], [9, 8, 7, 5]]})
    assert block_links(100)(rows).values.tolist() == [[1, 2]]
    assert block_links(60)(rows).values.tolist() == [[1, 2], [3, 4]]
    # two that have met in an earlier bucket do not meet again
    assert block_links(60)(rows.assign(met=[5, 5, 6, 7])).values.tolist() == [[3, 4]]


def test_result_does_not_depend_on_partitions(spark):
    rows = corpus(9, 10, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(jaccard_components(docs.repartition(7)).collect()) == sorted(jaccard_components(docs.orderBy(F.desc("doc_id")).coalesce(1)).collect())


def mixtures(seed: int, n: int) -> list[tuple[int, str]]:
    """Texts that are made of common passages only, so that all their shingles are frequent and most pairs are just short of a link."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}w{i}" for i in range(20)) for k in range(12)]
    return [(k, " ".join(rng.sample(passages, 8))) for k in range(n)]


@pytest.mark.parametrize("crowd", [8, 10_000])
def test_crowds_of_common_passages(spark, crowd):
    rows = mixtures(3, 160)
    j = Jaccard(percent=70, words=4, frequent=4, crowd=crowd, block=16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), j).collect()}
    assert got == brute(rows, j.words, j.percent)


def test_many_nodes_with_one_passage(spark):
    """A passage that all texts share makes no crowd, and two groups that one text bridges stay one bucket each."""
    rng = random.Random(6)
    passage = " ".join(f"q{k}" for k in range(30))
    rows = [(k, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for k in range(20_000)]
    docs = spark.createDataFrame(rows + [(20_000 + k, rows[k][1]) for k in range(50)], "doc_id long, text string")
    links = []
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, links_out=links).collect()}
    assert all(c == (i - 20_000 if i >= 20_000 else i) for i, c in got.items()) and len(got) == 20_050
    assert sum(x.count() for x in links) == 0

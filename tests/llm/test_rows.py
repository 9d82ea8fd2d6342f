"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.oracle import compare
from transfergraph.llm import decontam, fm_index, line_dedup, mixing, near_texts, quality_rules, queries, simhash, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert compare(spark, queries.queries()[name], queries.oracle_sql()[name]) > 0


# mixing


def test_mix_targets_and_reruns(make, prose):
    rows = [(k, prose(random.Random(k).randint(1, 400), k), f"s{k % 4}" if k % 9 else None) for k in range(300)] + [(1000, None, "s1"), (1001, "", "s1"), (1002, " \t\n", None)]
    rows += [rows[5], rows[5]]
    a = mixing.mix(make(rows)).toPandas()
    assert len(a) == len(rows)
    for _, g in a.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
        assert (g.taken <= 3 * g["size"]).all() and (g["size"].sum() == g.source_size).all()
        assert (g.taken % g["size"].where(g["size"] > 0, 1) == 0).all()
    first = a.drop_duplicates("source").sort_values("source", na_position="last")
    assert first.target.sum() == pytest.approx(a["size"].sum())
    b = mixing.mix(make(rows)).toPandas()
    assert sorted(map(tuple, a[["doc_id", "taken"]].values)) == sorted(map(tuple, b[["doc_id", "taken"]].values))


def test_mix_of_nothing_and_of_one_length(make):
    assert mixing.mix(make([])).count() == 0
    same = [(k, "one two three", "a" if k % 3 else "b") for k in range(3000)]
    a = mixing.mix(make(same)).toPandas()
    for _, g in a.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 3
    assert mixing.mix(make([(1, None, "a"), (2, "", None)])).toPandas().taken.sum() == 0


def test_targets_stop_at_three_times(spark):
    t = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")).collect()}
    assert t["a"] == 30 and t["b"] == pytest.approx(1980 * 2 / 3) and t["c"] == pytest.approx(1980 / 3)


def test_fit_against_brute_force():
    r = np.random.default_rng(1)
    for _ in range(200):
        size = np.unique(r.integers(1, 40, 6))
        count = r.integers(1, 5, len(size))
        budget = int(r.integers(0, int((size * count).sum()) + 1))
        sums = {0}
        for s, n in zip(size.tolist(), count.tolist(), strict=True):
            sums = {x + s * k for x in sums for k in range(n + 1)}
        take = mixing.fit(size, count, budget)
        got = int((size * take).sum())
        assert (take >= 0).all() and (take <= count).all() and got <= budget
        # the proportional start may rule out a sum, but never misses by a whole document of the least size
        assert got in sums and (got == budget or budget - got <= max(x for x in size.tolist()))
        items = [(k, s, n) for k, (s, n) in enumerate(zip(size.tolist(), count.tolist(), strict=True))]
        assert sum(size[k] * n for k, n in mixing.knapsack(items, budget)) == max(x for x in sums if x <= budget)


# quality rules


def test_quality_rules_edges(make, prose):
    good = "\n".join(prose(60, k) for k in range(3))
    rows = [(1, None), (2, ""), (3, good), (3, good), (None, good), (4, "a | b | c\n" * 60), (5, "WOW!! " * 100), (6, "x*** y$$$ " * 60), (7, "same words here. " * 60), (8, prose(120_000, 9))]
    got = quality_rules.apply_rules(make(rows)).toPandas()
    kept = {(None if i != i else int(i)): k for i, k in zip(got.doc_id, got.kept, strict=True)}
    assert len(got) == len(rows) and kept == {1: False, 2: False, 3: True, None: True, 4: False, 5: False, 6: False, 7: False, 8: True}
    assert quality_rules.apply_rules(make([])).count() == 0


def test_repeated_words_both_ways():
    r = random.Random(3)
    for n in (2, 3, 10, 500):
        words = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)]
        c = Counter(zip(words, words[1:], words[2:], strict=False))
        want = len({k + d for k in range(n - 2) if c[tuple(words[k : k + 3])] > 1 for d in range(3)})
        assert quality_rules.repeated_words(words) == want
    long = [str(r.randint(0, 300)).encode() for _ in range(100_500)]
    c = Counter(zip(long, long[1:], long[2:], strict=False))
    assert quality_rules.repeated_words(long) == len({k + d for k in range(len(long) - 2) if c[tuple(long[k : k + 3])] > 1 for d in range(3)})


# near-duplicates


def brute_fingerprint(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, bits=3):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_near_duplicates(make, prose):
    base = prose(300, 1).split()
    rows = [(k, prose(80 + k, k)) for k in range(20)] + [(100 + k, " ".join(base[:k] + ["zzz"] + base[k + 1 :])) for k in range(0, 300, 20)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "Two Words"), (204, "two words"), (205, "é ü ß ÀB"), (None, rows[0][1]), rows[3], rows[3], (300, "A\tb\x0bc\nd  e" * 3000)]
    got = simhash.near_duplicates(make(rows)).toPandas()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = Counter()
    roots = brute_components(fps)
    least = defaultdict(list)
    for (i, _), x in zip(rows, roots, strict=True):
        least[x] += [i] if i is not None else []
    for (i, _), f, x in zip(rows, fps, roots, strict=True):
        want[(i, f, min(least[x], default=None))] += 1
    have = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), int(r.fp) & (2**64 - 1), None if r.component_id != r.component_id else int(r.component_id)) for r in got.itertuples())
    assert have == want
    assert simhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("limit", [50_000, 20])
def test_links_of_dense_and_hot_groups(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_LIMIT", limit)
    r = random.Random(5)
    near = {(x := r.getrandbits(64)) for _ in range(150)}
    centre = r.getrandbits(64)
    for _ in range(400):
        x = centre
        for _ in range(r.randint(0, 8)):
            x ^= 1 << r.randrange(64)
        near.add(x)
    fps = sorted(near)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    at = {x: k for k, x in enumerate(signed)}
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for s, d in df.collect():
        label[root(at[s])] = root(at[d])
    mine = [root(k) for k in range(len(fps))]
    want = brute_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_one_of_each_group_stays(spark, make, prose):
    a, b = prose(200, 1), prose(200, 2)
    out = near_texts.stage(spark, make([(5, a), (3, a), (9, b), (9, b), (4, None), (6, "")]), "")
    assert sorted(r.doc_id for r in out.collect()) == [3, 4, 9]


def test_components_without_a_doc_id_or_with_a_common_one_keep_a_row_each(spark, make, prose):
    a, b, c, d, e = (prose(200, k) for k in range(1, 6))
    out = near_texts.stage(spark, make([(None, a), (None, a), (None, b), (None, c), (7, c), (5, d), (5, e), (6, d), (8, e)]), "")
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("None", a), ("None", b), ("7", c), ("5", d), ("5", e)])


def test_stage_drops_copies_of_similarity_0_8(spark, make, prose):
    """Copies with edits all over, against brute force on five-word shingles."""
    rows = []
    for g in range(12):
        base = prose(200, 700 + g).split()
        rows.append((1000 * g, " ".join(base)))
        for c in range(1, 6):
            words, r = list(base), random.Random(100 * g + c)
            for at in r.sample(range(200), c):
                words[at] = f"edit{r.random()}"
            rows.append((1000 * g + c, " ".join(words)))
    rows += [(50_000, "two words"), (50_001, "Two  words"), (50_002, ""), (50_003, None)]
    shingled = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(shingled):
        for j, y in enumerate(shingled[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)
    assert len(want) < 50
    assert sorted(r.doc_id for r in near_texts.stage(spark, make(rows), "").collect()) == want


# substring dedup


def brute_substrings(rows, window):
    first = {}
    words = [re.findall(WORD, t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [10_000, 0])
def test_substring_dedup(make, prose, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "KEY_SEGMENTS", hot)
    shared, other = prose(130, 50), prose(55, 51)
    rows = [(k, f"{prose(40 + k, k)} {shared} {prose(30, 90 + k)}") for k in range(6)] + [(20, shared), (21, other), (22, f"{other} x {other}"), (23, prose(70, 2)), (24, prose(70, 2)), (25, "w " * 400), (26, "w " * 120)]
    rows += [(30, None), (31, ""), (32, "short text"), (None, shared), rows[2], (3, prose(60, 7)), (40, shared.replace(" ", "\n"))]
    got = substring_dedup.dedup_substrings(make(rows), digest=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows, 50)
    assert substring_dedup.dedup_substrings(make([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_shard_against_scan(monkeypatch, seed):
    """Passages of few words with edits, copies and shared ids: no index holds what is streamed through it, lengths under the window are told, and every window's verdict is the scan's."""
    r, window, lengths = np.random.default_rng(seed), 33, []
    base = r.integers(1, 4, 70)
    passages, keys, docs = [], [], []
    for k in range(24):
        x = base.copy() if k % 3 else r.integers(1, 9, 70)
        x[r.integers(0, 70, k % 3)] = 9
        a = int(r.integers(0, 20))
        passages.append(x[a : a + int(r.integers(window, 50))].astype(np.int32))
        keys.append(k % 2)
        docs.append(int(r.integers(-3, 9)))
    whole = fm_index.FMIndex.matching_statistics

    def watched(index, stream, start, number):
        got = whole(index, stream, start, number)
        lengths.extend(got[0][a + window - 1 : a + n + window - 1].tolist() for a, n in zip(start, number, strict=True))
        return got

    monkeypatch.setattr(fm_index.FMIndex, "matching_statistics", watched)
    docs = np.array(docs)
    got = substring_dedup.least_before(passages, np.array(keys), docs, docs, window)
    having = [{tuple(p[k : k + window].tolist()) for k in range(len(p) - window + 1)} for p in passages]
    for p, d, key, (least, found) in zip(passages, docs, keys, got, strict=True):
        for k in range(len(p) - window + 1):
            w = tuple(p[k : k + window].tolist())
            same_key = any(w in having[x] and docs[x] < d and keys[x] == key for x in range(len(passages)))
            assert found[k] or not same_key
            assert not found[k] or any(w in having[x] and docs[x] == least[k] < d for x in range(len(passages)))
    told = [n for x in lengths for n in x]
    assert min(told) < window and max(told) == window


def test_unrelated_passages_find_nothing(prose):
    passages = [np.unique(prose(80, k).split(), return_inverse=True)[1].astype(np.int32) + 1 + 1000 * k for k in range(6)]
    docs = np.arange(6)
    assert not any(found.any() for _, found in substring_dedup.least_before(passages, np.zeros(6, int), docs, docs, 50))


def test_substring_dedup_of_a_very_long_text(make, prose):
    long = prose(25_000, 8)
    rows = [(1, long), (2, " ".join(long.split()[9_000:24_500])), (3, prose(60, 9))]
    got = substring_dedup.dedup_substrings(make(rows), digest=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_substrings(rows, 50)


# decontamination


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join("edit" if r.random() < share else w for w in text.split())


def test_decontamination(spark, make, prose):
    items = spark.createDataFrame([(k, prose(30 + 5 * k, 500 + k)) for k in range(5)] + [(10, None), (11, ""), (12, "two words")], "item_id long, text string")
    texts = {r.item_id: r.text for r in items.collect()}
    rows = [(k, prose(200, k)) for k in range(10)] + [(20 + k, f"{prose(90, 40 + k)} {texts[k].upper()} {prose(50, 60 + k)}") for k in range(5)]
    rows += [(30 + k, f"{prose(90, 140 + k)} {edited(texts[k], 0.12, k)} {prose(50, 160 + k)}") for k in range(5)] + [(40, None), (41, ""), (None, texts[1]), (42, "two words"), (20, rows[10][1])]
    got = decontam.leaks(make(rows), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(20 + k, k) for k in range(5)} | {(30 + k, k) for k in range(5)} | {(None, 1), (42, 12)}
    assert len([r for r in got if r.doc_id == 20]) == 2
    exact = next(r for r in got if r.doc_id == 21)
    assert exact.score == 1 and exact.first_word == 90
    clean = decontam.clean_documents(make(rows), items)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, [*range(10), 40, 41]))
    assert decontam.leaks(make([]), items).count() == 0 and decontam.leaks(make(rows), items.limit(0)).count() == 0


def planted(target, r, n):
    """Copies of a passage with up to 45 % of its words replaced, at every spacing or at random, or with words put in or left out, within other words."""
    other = lambda k: [f"o{r.randrange(900)}" for _ in range(k)]
    for _ in range(n):
        w, every, kind = target.split(), r.randint(2, 9), r.randrange(5)
        if kind == 0:
            w = [x if (k + 1) % every else "new" for k, x in enumerate(w)]
        elif kind == 1:
            w = [y for k, x in enumerate(w) for y in ([x] if (k + 1) % every else [x, "put"])]
        elif kind == 2:
            w = [x for k, x in enumerate(w) if (k + 1) % every]
        else:
            share = r.uniform(0, 0.45)
            w = [y for x in w for y in r.choice([["new"], [], [x, "put"]] if r.random() < share else [[x]])]
        yield " ".join(other(r.randint(0, 90)) + w + other(r.randint(0, 90)))


def test_no_leak_that_reaches_the_score_is_missed(spark, make, prose):
    """Every item against every whole text by alignment alone, the hard cases at the threshold among them."""
    r = random.Random(8)
    texts = {k: prose(n, 700 + k) for k, n in enumerate([8, 9, 15, 30, 31, 60])}
    texts[6] = "over and over and over and over and over and over and out"
    made = [t for k in texts for t in planted(texts[k], r, 40)] + ["and over and", "over and " * 3, "over over over over and and and", " ".join(texts[4].split()[:9] * 2)]
    rows = list(enumerate(made))
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    want = {}
    for i, t in rows:
        words = decontam.plain_words(t.encode())
        for k, text in texts.items():
            target = decontam.plain_words(text.encode())
            score = decontam.align(target, words)[0] / (2 * len(target))
            if score >= 0.5:
                want[i, k] = score
    got = decontam.leaks(make(rows), items).collect()
    assert {(g.doc_id, g.item_id): g.score for g in got} == want and len(got) == len(want)
    third = sum(1 for s in want.values() if s < 0.6)
    assert third > 5, "some are near the threshold"


def test_short_items(spark, make):
    items = spark.createDataFrame([(1, "yes"), (2, "two words"), (3, "three short words"), (4, "a line of seven words in all")], "item_id long, text string")
    rows = [(1, "yes"), (2, "yes it is"), (3, "first line\nTwo words.\nlast"), (4, "these two words"), (5, "with three short words inside"), (6, "three words short"), (7, "so a line of seven words in all there"), (8, "a line of seven other words in all"), (9, "\n\nYES!\n")]
    assert {(g.doc_id, g.item_id, g.first_word, g.last_word) for g in decontam.leaks(make(rows), items).collect()} == {(1, 1, 0, 0), (3, 2, 2, 3), (5, 3, 1, 3), (7, 4, 1, 7), (9, 1, 0, 0)}


def test_alignment_against_plain_smith_waterman():
    r = np.random.default_rng(2)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)).astype(np.uint64), r.integers(0, 4, r.integers(1, 20)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.align(a, b)[0] == h.max()


# line dedup


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(-(2**63) if i is None else i)
    out = []
    for i, t in rows:
        me = -(2**63) if i is None else i
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != me)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_line_dedup(make, prose):
    line, other = "This line is found in many documents.", "  a SECOND line of that kind, éè \r"
    rows = [(k, f"{prose(9, k)}\n{line if k % 2 else line.upper()}\n{prose(9, 50 + k)}\n{other}\n{line}") for k in range(6)]
    rows += [(7, None), (8, ""), (9, "\n\n"), (10, line), (None, f"{line}\nx"), rows[2], (3, f"another text of three\n{line}"), (11, "short\nshort"), (12, (prose(5, 3) + "\n") * 3000)]
    got = line_dedup.dedup_lines(make(rows)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.clean) for r in got) == brute_lines(rows)
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_line_dedup_runs_no_python(make):
    plan = line_dedup.dedup_lines(make([(1, "a")], extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark, tmp_path, make, prose):
    import corpus_pipeline

    items = spark.createDataFrame([(1, prose(40, 900))], "item_id long, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    text = "\n".join(prose(60, k) for k in range(4))
    rows = [(k, "\n".join(prose(70, 10 * k + j) for j in range(4)), f"s{k % 3}") for k in range(12)] + [(50, text, "s1"), (51, text, "s1"), (52, f"{prose(80, 77)}\n{prose(40, 900)}\n{prose(80, 78)}", "s2"), (53, "a | b | c", "s0"), (54, None, None)]
    docs = make(rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "decontaminate", "mix"]
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got.doc_id) == [*range(12), 50]
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].min()


def test_kept_text_is_a_sha256_of_utf8(make):
    out = line_dedup.dedup_lines(make([(1, "é\nß")])).select(F.sha2(F.col("clean").cast("binary"), 256).alias("s")).first().s
    assert out == hashlib.sha256("é\nß".encode()).hexdigest()


def test_phrases_are_whole_words():
    for line in ("The design in question took nine years to finish.", "They wrote a blog in the village and read it aloud.", "A catalog in the shop lists every plant and its price."):
        assert not quality_rules.line_fails(line)
    assert quality_rules.line_fails("Please sign in to read this page.") and quality_rules.line_fails("Log in or subscribe.")


@pytest.mark.parametrize("columns", [60, 72, 80])
def test_hard_wrapped_prose_stays(prose, columns):
    import textwrap

    text = "\n".join(textwrap.wrap(prose(400, columns), columns))
    judged = quality_rules.judge(text)
    assert judged[6] and judged[9] == judged[1]
    assert quality_rules.line_fails("A heading of some words that is long enough", "Then a sentence begins.") and quality_rules.line_fails("home page", "about us")

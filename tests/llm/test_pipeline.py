"""The pipeline, its stages and decontamination over whole tables, against brute force."""

from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_rows import brute_lines
from tests.oracle import SF
from transfergraph.llm import decontam, quality_rules
from transfergraph.llm.common import DOCUMENT_COLUMNS

STAGES = dict(corpus_pipeline.STAGES)


def _table(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def brute_leaks(rows, items, min_score=0.5):
    """{(row, item): score} by aligning every item with every whole text."""
    words = [decontam.plain_words((t or "").encode()) for _, t in rows]
    out = {}
    for item, text in items:
        target = decontam.plain_words((text or "").encode())
        if len(target) < 3:
            continue
        known = np.unique(target)
        for k, w in enumerate(words):
            if np.isin(w, known).sum() * 2 < len(target):  # too few equal words for half of the score
                continue
            score = decontam.align(target, w)[0] / (2 * len(target))
            if score >= min_score:
                out[k, item] = score
    return out


def brute_groups(texts, alike=0.8):
    """For each text the first one that it is linked to, by 5-word shingles of all pairs."""
    shingled = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(shingled):
        for j, y in enumerate(shingled[:i]):
            if min(len(x), len(y)) >= alike * max(len(x), len(y)) and len(x & y) >= alike * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(texts))]


def best_fill(sizes, most):
    """The largest sum of some of the sizes that is no more than `most`; bit k of `sums` says whether k is a sum."""
    sums = 1
    for n in sizes:
        sums |= sums << n
    return (sums & ((1 << (most + 1)) - 1)).bit_length() - 1


def test_decontamination_of_the_tables(spark):
    rows, items = _table("documents", "doc_id, text"), _table("benchmark", "item_id, text")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.op9(spark, SF).collect()}
    want = {(rows[k][0], item): score for (k, item), score in brute_leaks(rows, items).items()}
    assert got == pytest.approx(want) and got


def test_pipeline_of_the_tables(spark, tmp_path):
    rows = _table("documents", "doc_id, text, source")
    more = [(10_000, rows[0][1], "extra"), (10_001, None, "extra"), (10_002, "", None), (10_003, rows[1][1] + " one more word", rows[1][2]), (10_004, f"{rows[2][1]}\n{_table('benchmark', 'text')[0][0]}", None)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    added = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in more], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select(*DOCUMENT_COLUMNS).unionByName(added).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows += more

    judged = [(i, quality_rules.judge(t), s) for i, t, s in rows]
    source = {i: s for i, _, s in rows}
    at = [(i, j[10]) for i, j, _ in judged if j[6]]
    at = [(i, clean) for i, _, _, clean in brute_lines(at).elements()]
    at.sort(key=lambda r: r[0])
    first = brute_groups([t for _, t in at])
    at = [r for k, r in enumerate(at) if first[k] == k]
    leaks = {k for k, _ in brute_leaks(at, _table("benchmark", "item_id, text"))}
    at = [r for k, r in enumerate(at) if k not in leaks]
    assert 0 < len(at) < len(rows) and leaks

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter((i, source[i], len(t.encode().split())) for i, t in at)
    words = Counter()
    for i, t in at:
        words[source[i]] += len(t.encode().split())
    taken, target = Counter(), {r.source: r.target for r in got}
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == words[r.source] and r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    for s, t in target.items():
        passes = int(t // words[s]) if words[s] else 0
        assert taken[s] == passes * words[s] + best_fill([r["size"] for r in got if r.source == s], round(t - passes * words[s]))


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_empty_tables_and_odd_ids(spark, make, prose, tmp_path, name):
    """Three texts without an id, two that share one and a repeated row stay as they are (the repeated row once after near_duplicates); other columns don't matter."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = STAGES[name]
    last = name == "mix"
    none = stage(spark, make([]), str(tmp_path))
    assert none.count() == 0 and (last or none.columns == DOCUMENT_COLUMNS)
    rows = [(None, prose(120, 1)), (None, prose(120, 2)), (None, prose(140, 3)), (7, prose(120, 4)), (7, prose(120, 5)), (8, prose(120, 6)), (9, prose(20_000, 7)), (10, prose(120, 8)), (10, prose(120, 8))]
    for extra in (True, False):
        out = stage(spark, make(rows, extra), str(tmp_path)).collect()
        have = Counter(r.doc_id for r in out) if last else Counter((r.doc_id, r.text) for r in out)
        want = Counter(i for i, _ in rows) if last else Counter(set(rows) if name == "near_duplicates" else rows)
        assert have == want
    blank = [(1, None), (2, ""), (None, None), (3, " \n\t")]
    n = {"quality_rules": 0, "near_duplicates": 1}.get(name, 4)
    assert stage(spark, make(blank), str(tmp_path)).count() == n

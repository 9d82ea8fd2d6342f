"""Operators 11 to 13 against brute force, with nulls, empty and long values, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from transfergraph.llm import pii, prefix_trie, vector_codes

# personal data


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled_table(spark))


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and plain_luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_fixed_patterns_against_the_contract():
    r = random.Random(3)
    pieces = ["a", "b.c", "@", "@@", ".", "x@y.z", "@y.z_", "1", "23", "999", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (503) 555-7713", "+", "++1", " ", "-", "\n", "é", "%", "(", "4012888888881881", "00000000000000000000"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_fixed_patterns_on_long_runs():
    long = "a" * 300_000 + "@" + "b" * 300_000 + " " + "7" * 300_000 + " +" + "1" * 300_000
    assert pii.base_spans(long) == []
    assert pii.base_spans("1" * 5000 + ".1.1.1") == []


def test_gradient_against_differences():
    g = np.random.default_rng(0)
    scores, steps = g.normal(size=(3, 5, 9)), g.normal(size=(9, 9))
    mask = np.arange(5)[None] < np.array([5, 3, 1])[:, None]
    labels = g.integers(0, 9, (3, 5)) * mask
    _, by_score, by_step = pii.likelihood(scores, mask, labels, steps)
    for _ in range(20):
        at = tuple(g.integers(0, n) for n in scores.shape)
        up = scores.copy()
        up[at] += 1e-5
        assert (pii.likelihood(up, mask, labels, steps)[0] - pii.likelihood(scores, mask, labels, steps)[0]) / 1e-5 == pytest.approx(by_score[at], abs=1e-4)
        at = tuple(g.integers(0, 9, 2))
        up = steps.copy()
        up[at] += 1e-5
        assert (pii.likelihood(scores, mask, labels, up)[0] - pii.likelihood(scores, mask, labels, steps)[0]) / 1e-5 == pytest.approx(by_step[at], abs=1e-4)


def test_viterbi_against_all_labellings():
    g = np.random.default_rng(1)
    lengths = np.array([4, 2, 3, 1])
    scores, steps = g.normal(size=(4, 4, 3)), g.normal(size=(3, 3))
    got = pii.viterbi(scores, steps, lengths)
    for k, n in enumerate(lengths):
        def worth(y):
            path = [0, *y, 0]
            return sum(scores[k, t, v] for t, v in enumerate(y)) + sum(steps[a, b] for a, b in itertools.pairwise(path))
        assert tuple(got[k, :n]) == max(itertools.product(range(3), repeat=n), key=worth)


def test_cut_chains_are_whole_chains(field):
    """Labels of the runs of open words are those of Viterbi over whole documents."""
    r = random.Random(5)
    words = [w for line in pii.LABELLED for w in pii.MARK.sub(r"\2", line).split()]
    texts = [[r.choice(words) for _ in range(n)] for n in (0, 1, 2, 40, 300, 7, 300)]
    decoder = pii.Decoder(field)
    for words, (at, tags) in zip(texts, decoder.labels(texts), strict=True):
        want = np.zeros(len(words), np.int64)
        if words:
            ids = np.concatenate(([0, 0], decoder.numbers(words), [0, 0]))
            scores = decoder._scores(ids, np.arange(2, 2 + len(words)))
            want = pii.viterbi(scores[None], field.steps, np.array([len(words)]))[0]
        got = np.zeros(len(words), np.int64)
        got[at] = tags
        assert (got == want).all()


HELD_OUT = """
You may call {phone:(718) 555-0133} tonight.
Our line is {phone:212-555-0199} since May.
Rufen Sie uns unter {phone:040 428 32-0} an.
Mon numéro est le {phone:02 99 28 55 55} à Rennes.
Mi número es {phone:93 402 70 00} en casa.
Ask {email:tom at example dot net} about it.
mail {email:rose(at)example.org} first
Schreiben Sie an {email:otto punkt klein at example punkt de} heute.
Escriba a {email:eva arroba example punto com} mañana.
It came from {ip:192[.]0[.]2[.]14} twice.
address {ip:2001:db8::ff00:42:8329} is new
The card {card:5500.0000.0000.0004} is void.
Amex {card:3787 344936 71000} was used
In 1848 the war began, in 1871 it ended.
Version 2.4.1 of part 9921-A costs 17.50 now.
Invoice 88120934 is paid, page 3 of 12.
The man looked at the point and then at the sea.
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was it
""".strip().split("\n")


def test_field_on_held_out_sentences(field):
    """Spans of sentences that the field has not seen; none of them but where marked."""
    decoder, hit, want, false = pii.Decoder(field), 0, 0, 0
    for line in HELD_OUT:
        text, spans, at = "", set(), 0
        for m in pii.MARK.finditer(line):
            text += line[at : m.start()]
            spans.add((m.group(1), len(text), len(text) + len(m.group(2))))
            text, at = text + m.group(2), m.end()
        text += line[at:]
        got = set(pii.joined(pii.base_spans(text), pii.field_spans(text, *decoder.labels([pii.WORDS.findall(text)])[0])))
        hit, want, false = hit + len(got & spans), want + len(spans), false + len(got - spans)
    assert hit >= 0.8 * want and false <= 1


def test_personal_data_rows(spark, make, field):
    long = "the of and " * 60_000 + "write to bob at example dot org now"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "x@y.example and 10.0.0.1"), (4, "x@y.example and 10.0.0.1"), (None, "Tel: (415) 555-2671 now"), (6, long), (7, "é😀 Call 555-123-4567."), (8, "+1 (826) 555-4081 190.137.223.204")]
    got = pii.find_personal_data(make(rows), field).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, k): r for k, r in enumerate(sorted(got, key=lambda r: r.doc_id or 0))}
    spans = defaultdict(list)
    for (doc, _), r in by.items():
        spans[doc].append([tuple(s) for s in r.spans])
    assert spans[1] == spans[2] == spans[3] == [[]]
    assert spans[4] == [[("email", 0, 11), ("ip", 16, 24)]] * 2
    assert spans[None] == [[("phone", 5, 19)]]
    start = len("the of and " * 60_000) + 9
    assert spans[6] == [[("email", start, start + 22)]]
    assert spans[7] == [[("phone", 8, 20)]]
    assert spans[8] == [[("ip", 18, 33), ("phone", 0, 17)]]
    assert pii.find_personal_data(make([]), field).count() == 0
    none = pii.fit(pii.labelled_table(spark).limit(0))
    assert [tuple(s) for r in pii.find_personal_data(make(rows[3:4]), none).collect() for s in r.spans] == [("email", 0, 11), ("ip", 16, 24)]


def test_op11_over_the_whole_table(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = pii.op11(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = plain_base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        drawn = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(drawn.encode()).hexdigest()
        assert set(filter(None, drawn.split(","))) <= set(r.spans.split(","))


# vector codes


def plain_codes(vectors, parts=16, entries=64, rounds=2):
    """vectors: (vec_id, integer components) in order of vec_id."""
    width = len(vectors[0][1]) // parts
    part = lambda x, p: x[p * width : (p + 1) * width]
    books = [[part(x, p) for _, x in vectors[:entries]] for p in range(parts)]
    far = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, x in vectors:
                groups[nearest(part(x, p), books[p])].append(part(x, p))
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out = []
    for v, x in vectors:
        code = [nearest(part(x, p), books[p]) for p in range(parts)]
        out.append((v, "".join(f"{c:02x}" for c in code), sum(far(part(x, p), books[p][c]) for p, c in enumerate(code))))
    return out, books


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string, n string, sums string, code string").repartition(3)


def test_codes_against_brute_force(spark):
    r = random.Random(2)
    rows = [(k, [r.choice([-0.51, -0.01, 0.0, 0.13, 0.77]) if r.random() < 0.8 else r.uniform(-3, 3) for _ in range(32)], r.choice([None, 1, 2])) for k in range(300)]
    rows[10] = (10, rows[3][1], None)
    bad = [(400, None, 1), (401, [0.1] * 31 + [None], 1), (402, [0.1] * 31 + [float("nan")], 1), (403, [0.1] * 31 + [float("inf")], 1), (404, [0.1] * 16, 1), (405, [], 1)]
    full = [(*row, "clash", "clash", "clash", "clash") for row in rows + bad]
    coded, books = vector_codes.compress(_vectors(spark, full))
    got = sorted((c.vec_id, c.code.hex(), c.error) for c in coded.collect())
    scaled = [(k, [int(np.floor(256 * np.float64(np.float32(v)))) for v in x]) for k, x, _ in rows]
    want, plain = plain_codes(scaled)
    assert got == want and books.tolist() == plain


def test_codes_of_few_repeated_and_large_vectors(spark):
    rows = [(1, [1e30] + [0.0] * 15, 1), (1, [1e30] + [0.0] * 15, 1), (None, [-1e30] + [0.5] * 15, None)]
    coded, books = vector_codes.compress(_vectors(spark, [(*row, *"abcd") for row in rows]))
    got = coded.collect()
    assert len(got) == 3 and books.shape == (16, 3, 1) and {c.error for c in got} == {0}
    assert abs(books[0]).max() == vector_codes._limit(16)
    none, _ = vector_codes.compress(_vectors(spark, [(1, None, 1, *"abcd")]))
    assert none.count() == 0
    assert vector_codes.compress(_vectors(spark, []))[0].count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(_vectors(spark, [(1, [0.1] * 17, 1, *"abcd")]))


def test_trie_walk_against_all_distances():
    g = np.random.default_rng(4)
    for dims in (1, 2, 4, 7):
        x, books = g.integers(-2, 3, (500, dims)), g.integers(-3, 4, (64, dims))
        distinct, place = vector_codes._trie(x)
        code, error = vector_codes.nearest(distinct, books)
        far = ((x[:, None] - books[None]) ** 2).sum(axis=2)
        assert (distinct[place] == x).all() and (code[place] == far.argmin(axis=1)).all() and (error[place] == far.min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    r = random.Random(9)
    rows = [(k, [r.uniform(-1, 1) for _ in range(16)], 1, *"abcd") for k in range(200)]
    coded, books = vector_codes.compress(_vectors(spark, rows))
    for c in vector_codes.decode(coded, books).collect():
        off = sum((a - b) ** 2 for a, b in zip(rows[c.vec_id][1], c.decoded, strict=True))
        assert len(c.decoded) == 16 and off <= (c.error**0.5 / 256 + 16**0.5 / 256) ** 2


# prefix trie


def plain_trie(rebuilt):
    """rebuilt: conv_id -> list of (turn, words)."""
    nodes = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes[tuple(t for t, _ in turns[:d])].append(c)
    words = {tuple(t for t, _ in turns[:d]): turns[d - 1][1] for turns in rebuilt.values() for d in range(1, len(turns) + 1)}
    parents = {p[:-1] for p in nodes if p}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(rebuilt[c]) == len(p))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(1 for q in nodes if q and q[:-1] == p), sum(q not in parents for q in below),
                    sum((len(nodes[q]) - 1) * words.get(q, 0) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    key = lambda t: (*t[:3], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()[:16])
    own = {c: [((t[2], t[3]), len(re.findall(r"[^\x20\x09-\x0D]+", t[3]))) for t in sorted(ts, key=key)] for c, ts in turns.items()}
    out = {}
    for c in own:
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4
        out[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + own[c][h:]
    return out


def _turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    for c in ("items", "s", "n", "node", "depth", "k", "parent"):
        df = df.withColumn(c, F.lit("clash"))
    return df


def _trie(spark, rows):
    got = prefix_trie.prefix_trie(prefix_trie.share_openings(prefix_trie.turn_sequences(_turns(spark, rows))))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    r = random.Random(seed)
    said = ["hello there", "", None, "one two three", "a\tb\nc", "x"]
    rows = []
    for c in [*range(-45, 70), 10**12, 10**12 + 1]:
        if r.random() < 0.1:
            continue
        rows += [(c, r.choice([None, k, k, k]), r.choice(["user", "user", None]), r.choice(said)) for k in range(r.choice([1, 1, 2, 3, 5, 9, 17]))]
    rows += [(c, k, "user", "copied") for c in range(100, 160) for k in range(6)]
    rows += [rows[0], rows[0], (None, 1, "user", "lost")]
    assert _trie(spark, rows) == plain_trie(plain_rebuilt(rows))


def test_trie_of_nothing_of_one_and_of_long_conversations(spark):
    assert _trie(spark, []) == [] == _trie(spark, [(None, 1, "user", "x")])
    one = [(20, 0, "user", "x y")]
    assert _trie(spark, one) == plain_trie(plain_rebuilt(one))
    turnless = [(c, 0, "user", "x") for c in range(41, 60) if (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4][:3]
    assert _trie(spark, turnless) == plain_trie(plain_rebuilt(turnless)) and len(_trie(spark, turnless)) == 1
    long = [(0, k, "user", f"turn {k % 7}") for k in range(150)] + [(1, k, "user", f"turn {k % 7}") for k in range(149)] + [(1, 149, "user", "the end " * 50_000)]
    assert _trie(spark, long) == plain_trie(plain_rebuilt(long))


def test_hot_openings_meet_a_broadcast(spark):
    """More conversations than one part in a thousand behind one opening: the join with its name takes both ways."""
    rows = [(20 * c, 0, "user", "hot") for c in range(1500)] + [(20 * c, 1, "user", f"own {c % 700}") for c in range(1500)]
    got = _trie(spark, rows)
    first = [r for r in got if r[1] == 1]
    assert len(first) == 1 and first[0][:6] == (0, 1, 0, 1500, 700, 700) and first[0][6] == 1499 + 2 * 800

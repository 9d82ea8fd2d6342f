"""Chat formatting by exact round trips, models by held-out accuracy and numeric checks."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from transfergraph.llm import chat_format, fm_index, language_id, toxicity, weak_quality

# chat formatting

TURNS = "conv_id long, turn long, role string, text string"


def brute_chat(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        lost = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "a\\b\\\\", "\\[INST]", "[\\INST]", "", None, "日本語 é 🙂🙂", "<s", "</s", "s>", " lead and trail \n", "[INST][INST]", "a <|endoftext|> b", "x" * 5000, "\\"]
    rows = [(k, t, ("user", "assistant")[t % 2], odd[(k + t) % len(odd)]) for k in range(20) for t in range(k % 5 + 1)]
    rows += [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 0, "sys\ntem[/INST]", "c"), (51, None, None, "d"), (None, 0, "assistant", "no id"), (52, 0, "user", "twice"), (52, 0, "user", "twice")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS + ", ids string").repartition(3)
    formatted = chat_format.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(formatted).collect()}
    assert got == brute_chat(rows)
    one = formatted.where("conv_id = 2").first()
    assert len(one.ids) == len(one.mask) == len(one.starts) and one.starts == sorted(one.starts)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_template_hides_control_strings():
    t = chat_format.Template()
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["[INST]", "[/INST]", "</s>", "<s>", "\\", "<", "[", "/", "s>", "é"]) for _ in range(r.randint(0, 9)))
        assert t.unescape(t.escape(text)) == text and not any(c in t.escape(text) for c in t.controls)


def test_mask_against_scan():
    r = np.random.default_rng(3)
    spans = np.array([[3, 9], [9, 9], [12, 20], [25, 31]])
    offsets = np.array([[a, a + int(r.integers(0, 3))] for a in range(35)])
    want = [int(b > a and any(s <= a and b <= e for s, e in spans)) for a, b in offsets]
    assert chat_format.loss_mask(offsets, spans).tolist() == want
    assert chat_format.loss_mask(offsets, np.empty((0, 2), int)).sum() == 0


# FM-index


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_against_scan(seed):
    """Streams that are partly in the index and partly not, with symbols that the index lacks."""
    r, window = np.random.default_rng(seed), 40
    base = r.integers(1, 6, 400)
    passages = [np.concatenate((base[k : k + 90], [0])) for k in (0, 60, 200)] + [np.concatenate((r.integers(1, 6, 70), [0]))]
    text = np.concatenate(passages)
    streams = [base[:400], np.concatenate((base[10:70], [-1], base[210:280])), r.integers(1, 6, 60), np.concatenate((r.integers(1, 6, 20), base[30:80], r.integers(1, 6, 20))), base[50:90]]
    stream, lengths = np.concatenate(streams), np.array([len(x) for x in streams])
    start, number = np.cumsum(lengths) - lengths, lengths - window + 1
    index = fm_index.FMIndex(text, window)
    lengths, lows = index.matching_statistics(stream, start, number)
    found = [(w, e) for w, x in enumerate(streams) for e in range(window - 1, len(x)) if lengths[start[w] + e] == window]
    assert found and (lengths[[start[w] + e for w, x in enumerate(streams) for e in range(window - 1, len(x))]] < window).any()
    for w, e in found:
        low = int(lows[start[w] + e])
        group = index.order[low : np.append(index.starts, len(text))[np.searchsorted(index.starts, low) + 1]]
        assert set(group.tolist()) == {k for k in range(len(text) - window + 1) if (text[k : k + window] == streams[w][e - window + 1 : e + 1]).all()}
    held = {tuple(text[k : k + n].tolist()) for n in range(1, window + 1) for k in range(len(text) - n + 1)}
    for w, x in enumerate(streams):
        for e in range(window - 1, len(x)):
            n = 0
            while n < window and tuple(x[e - n : e + 1].tolist()) in held:
                n += 1
            assert lengths[start[w] + e] == n
    with pytest.raises(ValueError):
        fm_index.FMIndex(text, 20)


# models on the driver's tables

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = language_id.fit(docs, ~language_id.held_out(), fit_rows=200, epochs=8)
    got = language_id.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").where(language_id.held_out())
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, make, prose):
    docs = make([(1, None), (2, ""), (3, "123 !?"), (4, prose(20_000, 1)), (4, prose(20_000, 1)), (None, prose(50, 2)), (5, prose(50, 3), "s", None), (6, "Ω", "s", "el"), (7, prose(60, 4), "s", "xx")])
    net = language_id.fit(docs, F.lit(True), epochs=2)
    assert net.languages == ["el", "en", "xx"]
    got = {(r.doc_id, r.lang_pred == "und") for r in language_id.predict(docs, net).collect()}
    assert got == {(1, True), (2, True), (3, True), (4, False), (None, False), (5, False), (6, False), (7, False)}
    assert language_id.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), net).count() == 0


def test_network_gradients():
    """Against differences of the loss, in double precision; the loss goes through the forward pass that predicts, the gradients through the one that trains."""
    r = np.random.default_rng(5)
    net = language_id.Network.fresh(["a", "b", "c"], 1)
    net.embed, net.out = net.embed.astype(float), net.out.astype(float)
    net.bias, net.out_bias = r.normal(0, 0.1, net.bias.shape), r.normal(0, 0.1, net.out_bias.shape)
    net.filters = {w: f.astype(float) for w, f in net.filters.items()}
    x, y = r.integers(0, 255, (6, 32)).astype(np.uint8), np.array([0, 1, 2, 1, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    g = net.gradients(x, y)
    for name, grad in g.items():
        at = net.filters[name] if name in net.filters else getattr(net, name)
        assert grad.shape == at.shape and np.abs(grad).max() > 0
        for place in r.permutation(np.argwhere(grad != 0))[:12]:
            place = tuple(place)
            kept, ends = at[place], []
            for step in (1e-6, -1e-6):
                at[place] = kept + step
                ends.append(loss())
            at[place] = kept
            assert grad[place] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-4, abs=1e-8)


def test_network_learns():
    r = np.random.default_rng(5)
    net = language_id.Network.fresh(["a", "b"], 1)
    x, y = r.integers(0, 255, (6, 32)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    before = -np.log(net.probabilities(x)[np.arange(6), y]).mean()
    net.train(x, y, 30, 1e-2, 2)
    assert -np.log(net.probabilities(x)[np.arange(6), y]).mean() < 0.2 * before


def test_toxicity_held_out(spark, make, prose):
    rude = ["zorg", "blick", "fnord"]
    r = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        bad = r.random() < 0.3
        words = prose(r.randint(20, 120), k).split()
        for _ in range(2 * bad):
            words.insert(r.randrange(len(words)), r.choice(rude))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    docs = make(rows + [(900, None), (901, ""), (None, "zorg blick"), rows[0]])
    known = spark.createDataFrame(labels + [(0, 0), (902, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    assert 0 < len(model[0]) < 5000
    got = toxicity.score(docs, model).join(spark.createDataFrame(labels, "doc_id long, y int"), "doc_id").where(toxicity.held_out())
    assert got.where("predicted <> y").count() <= 0.03 * got.count()
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).where("doc_id >= 900 or doc_id is null").collect()}
    assert scores[900] == scores[901] < 0.3 < scores[None]
    assert toxicity.fit(docs, known.limit(0))[2] == 0.0 and toxicity.score(docs.limit(0), model).count() == 0


def test_labels_of_held_out_rows_are_not_used(spark, make, prose):
    docs = make([(k, prose(40, k)) for k in range(200)])
    known = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, known), toxicity.fit(docs, turned)
    assert a[2] == b[2] and (a[0] == b[0]).all() and (a[1] == b[1]).all()


def test_em_finds_accuracies():
    r = np.random.default_rng(7)
    truth = r.random(20_000) < 0.7
    right = [0.95, 0.9, 0.8, 0.7, 0.6, 0.9, 0.85, 0.75, 0.65]
    votes = np.stack([np.where(r.random(len(truth)) < 0.2, weak_quality.NONE, np.where(r.random(len(truth)) < p, truth, ~truth)) for p in right], axis=1).astype(int)
    pattern = (votes * 3 ** np.arange(8, -1, -1)).sum(axis=1)
    assert (weak_quality.digits(pattern) == votes).all()
    u, inverse, count = np.unique(pattern, return_inverse=True, return_counts=True)
    posterior, table, share = weak_quality.expect(u, count.astype(float))
    assert abs(share - truth.mean()) < 0.02
    assert abs(table[1, 0, 1] / (table[1, 0, 0] + table[1, 0, 1]) - 0.95) < 0.02
    assert ((posterior[inverse] > 0.5) == truth).mean() > 0.97


def test_quality_against_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = weak_quality.classify(docs).join(labels, "doc_id")
    assert got.where("kept <> (quality = 1)").count() <= 0.03 * got.count()


def test_quality_edges(make, prose):
    docs = make([(1, None), (2, ""), (3, prose(100, 1)), (3, prose(100, 1)), (None, prose(100, 2)), (4, "a | b | c\n" * 80), (5, prose(30_000, 3))])
    got = weak_quality.classify(docs).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert weak_quality.classify(docs.limit(0)).count() == 0


def test_models_are_fitted_on_whole_texts(spark, make, prose, monkeypatch):
    text = f"{prose(25_000, 1)} insidemiddle {prose(25_000, 2)}"
    assert text.index("insidemiddle") > 100_000 and len(text) - text.index("insidemiddle") > 100_000
    docs, got = make([(k, f"{text} {k}") for k in range(4)]), {}
    monkeypatch.setattr(weak_quality, "fit_scorer", lambda rows: got.update(quality=rows) or (np.zeros(1 << weak_quality.BITS, np.float32), 0.0))
    monkeypatch.setattr(toxicity, "fit_ftrl", lambda rows: got.update(toxic=rows) or (np.zeros(1 << toxicity.BITS, np.float32), 0.0))
    weak_quality.classify(docs)
    toxicity.fit(docs, spark.createDataFrame([(k, 1) for k in range(4)], "doc_id long, toxic int"))
    whole = [f"{text} {k}".encode() for k in range(4)]
    assert sorted(r[0].tolist() for r in got["quality"]) == sorted(weak_quality.features(t)[0].tolist() for t in whole)
    known = [np.unique(toxicity.features(t)).tolist() for t in whole]
    assert got["toxic"] and all(r[0].tolist() in known for r in got["toxic"])


def test_toxicity_of_the_tables(spark):
    """Held-out documents of the given table that are labelled toxic: nine of ten are found, hardly any other."""
    import duckdb

    sf = "/root/testdata/sf0.1"
    marked = dict(duckdb.connect().execute(f"SELECT doc_id, max(toxic) FROM '{sf}/labels.parquet' WHERE toxic IS NOT NULL GROUP BY 1").fetchall())
    got = [(marked[r.doc_id], r.predicted) for r in toxicity.op8(spark, sf).where("held_out").collect() if r.doc_id in marked]
    toxic, clean = [p for y, p in got if y], [p for y, p in got if not y]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)

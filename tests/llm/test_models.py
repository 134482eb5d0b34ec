"""op4, op7 and op10: held-out accuracy on made-up data, contracts and edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliomill.llm import html_blocks as H
from foliomill.llm import language as L
from foliomill.llm import toxicity as T

# ---- language --------------------------------------------------------------------------------------------------


def prose(r, syllables, n):
    return " ".join("".join(r.choices(syllables, k=r.randrange(1, 4))) for _ in range(n))


TONGUES = {"aa": ["ba", "di", "ku", "lo"], "bb": ["sch", "ein", "ver", "ung"], "cc": ["né", "eau", "oi", "què"]}


def test_op4_held_out_accuracy_and_edges(docs):
    r = random.Random(4)
    rows = [(k, prose(r, TONGUES[lang], r.randrange(3, 60)), lang, "s") for k in range(600) for lang in [r.choice(list(TONGUES))]]
    model = L.learned(docs(rows[:400]), sample=300)
    assert model[0] == ["aa", "bb", "cc"] and np.allclose(np.linalg.norm(model[1], axis=1), 1, atol=1e-4)
    edge = [(9000, None, None, "s"), (9001, "", "aa", "s"), (9002, "12 !? 3", "aa", "s"), (9003, "a" * 600_000, None, "s"), (9004, "漢字 かな", None, "s")]
    got = {x.doc_id: x for x in L.identify(docs(rows[400:] + edge), model).collect()}
    right = sum(got[i].lang_pred == lang for i, _, lang, _ in rows[400:])
    assert right / 200 > 0.97
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (9000, 9001, 9002)) and got[9003].lang_pred != "und" and got[9004].lang_pred in model[0]
    assert all(0 <= x.score <= 1 for x in got.values())


def test_op4_binding_is_the_definition():
    a, b, c = L.bound_vectors()
    s = [0, 1, 2, 3, 0]
    want = sum(np.roll(c[x], 2).astype(int) * np.roll(c[y], 1) * c[z] for x, y, z in zip(s, s[1:], s[2:], strict=False))
    assert (L.profiles(["Abc"])[0][0] == want).all() and (L.profiles(["..ABC!"])[0][0] == want).all()


def test_op4_pieces_and_nothing_learned(docs, monkeypatch):
    text = prose(random.Random(5), TONGUES["aa"], 3000)
    whole = L.profiles([text])[0]
    for piece in (5_000, 7, 1):
        monkeypatch.setattr(L, "PIECE", piece)
        assert (L.profiles([text[:9_000] if piece < 9 else text])[0] == (L.profiles([text[:9_000]])[0] if piece < 9 else whole)).all()
    monkeypatch.setattr(L, "PIECE", 1 << 18)
    short = L.profiles([text[:9_000]])[0]
    monkeypatch.setattr(L, "PIECE", 7)
    assert (L.profiles([text[:9_000]])[0] == short).all()
    assert L.profiles(["\U000e0041\U000f0000", "\U00020001", None, "12 ."])[1].tolist() == [False, True, False, False]
    model = L.learned(docs([(1, "abc", None, "s")]))
    assert [x.lang_pred for x in L.identify(docs([(1, "abc", None, "s")]), model).collect()] == ["und"]
    assert L.identify(docs([]), model).count() == 0


# ---- toxicity ----------------------------------------------------------------------------------------------------


def labelled(seed, n):
    r = random.Random(seed)
    words = [prose(r, ["an", "th", "er", "on", "st"], 1) for _ in range(200)]
    rows, y = [], []
    for k in range(n):
        w = r.choices(words, k=r.randrange(5, 80))
        bad = r.random() < 0.2
        if bad:
            w[r.randrange(len(w))] = r.choice(["grolk", "grolker", "vexo"])
        if bad and r.random() < 0.8 or r.random() < 0.03:
            w.append("immigrants")  # the group is mentioned far more often in toxic texts
        rows.append((k, " ".join(w)))
        y.append((k, int(bad)))
    return rows, y


def test_op10_held_out_and_counterfactual(spark, docs):
    rows, y = labelled(1, 900)
    labels = spark.createDataFrame(y, "doc_id bigint, toxic int")
    model = T.trained(docs(rows), labels.where("doc_id < 600"), sample=500)
    edge = [(9000, None), (9001, ""), (9002, "Immigrants and refugees came by."), (9003, "x " * 200_000)]
    got = {x.doc_id: x.score for x in T.scored(docs(rows[600:] + edge), model, keep=["doc_id", "score"], score_col="toxicity").toDF("doc_id", "other", "score").collect()}
    with pytest.raises(ValueError):
        T.scored(docs(edge), model, keep=["score"])
    truth = dict(y)
    right = sum((got[k] >= 0.5) == bool(truth[k]) for k, _ in rows[600:])
    assert right / 300 > 0.97
    assert all(got[k] < 0.5 for k in (9000, 9001, 9002, 9003)) and all(0 <= s <= 1 for s in got.values())


def test_op10_the_penalty_takes_weight_off_group_terms():
    rows, y = labelled(2, 500)
    row, feature, mentions = [], [], []
    where = {x: k for k, x in enumerate(T.IDENTITY)}
    for k, (_, t) in enumerate(rows):
        data = np.frombuffer(t.encode(), np.uint8)
        f = T.features(data, np.array([0, len(data)]))[1]
        row.append(np.full(len(f), k))
        feature.append(f)
        mentions.append([where[w] for w in set(t.split()) if w in where])
    args = (np.array([x for _, x in y]), np.concatenate(row), np.concatenate(feature), mentions)
    term = T.term_features()[where["immigrants"]]
    free, held = (abs(T.fit(*args, swap=s)[0][term].sum()) for s in (0.0, 1.0))
    assert held < 0.25 * free


def test_op10_neutral_mentions_are_no_longer_rejected():
    """Texts without a bad word that mention the group: false positives of the fit without and with the penalty."""
    rows, y = labelled(4, 500)
    where = {x: k for k, x in enumerate(T.IDENTITY)}
    pair = [(lambda d: T.features(d, np.array([0, len(d)]))[1])(np.frombuffer(t.encode(), np.uint8)) for _, t in rows]
    mentions = [[where[w] for w in set(t.split()) if w in where] for _, t in rows]
    args = (np.array([x for _, x in y]), np.repeat(np.arange(len(pair)), [len(p) for p in pair]), np.concatenate(pair), mentions)
    r = random.Random(8)
    neutral = [" ".join(r.choices([w for w in rows[0][1].split() + rows[1][1].split() if w not in ("grolk", "grolker", "vexo", "immigrants")], k=6) + ["immigrants"]) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(neutral, pa.string())], ["text"])
    wrong = {}
    for swap in (0.0, 1.0):
        (out,) = T.scores(iter([batch]), *T.fit(*args, swap=swap))
        wrong[swap] = sum(x >= 0.5 for x in out.column(0).to_pylist())
    print("false positives of 200 neutral mentions:", wrong)
    assert wrong[0.0] >= 10 and wrong[1.0] == 0


def test_op10_scores_are_the_sums_of_the_words_weights():
    r = np.random.Generator(np.random.PCG64(3))
    weights, texts = r.normal(0, 0.1, T.WIDTH).astype(np.float32), ["Grolk grolk, vexo! Été é", "", None, "a b c " * 50, "x" * 3_000]
    (got,) = T.scores(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])]), weights, -0.5)
    for t, s in zip(texts, got.column(0).to_pylist(), strict=True):
        z = -0.5
        for word in set(re.findall(rb"[a-z\x80-\xff]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))):
            data = np.frombuffer(word, np.uint8)
            z += float(weights[T.features(data, np.array([0, len(data)]))[1]].sum())
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_op4_profiles_are_the_bundles_of_bound_trigrams():
    a, b, c = L.bound_vectors()
    symbol, _ = L.letter_tables()
    for text in ("Abc, déf  ghi", "a", "", "  x-y ", "ñandú 12 ñandú"):
        s = " " + "".join(x if symbol[ord(x)] else " " for x in text) + " "
        while "  " in s:
            s = s.replace("  ", " ")
        want = np.zeros(L.DIMENSIONS)
        for x, y, z in zip(s, s[1:], s[2:], strict=False):
            i, j, k = (0 if q == " " else int(symbol[ord(q)]) for q in (x, y, z))
            want += a[i].astype(int) * b[j] * c[k]
        assert (L.profiles([text])[0][0] == want).all()


def test_op7_labels_are_those_of_one_page_and_one_block_at_a_time():
    r = np.random.Generator(np.random.PCG64(2))
    pages = [H.blocks(H.made_page(r)[0]) for _ in range(12)]
    model = H.Labeller.fresh(3)
    p, n = model.p, H.HIDDEN
    for page, got in zip(pages, model.label(pages), strict=True):
        x, states = H.vectors([page]).astype(float), {}
        for w, order in (("f", range(len(page))), ("b", range(len(page) - 1, -1, -1))):
            state, cell = np.zeros(n), np.zeros(n)
            for t in order:
                z = x[t] @ p[w + "x"] + p[w + "1"] + state @ p[w + "h"]
                i, f, o = (1 / (1 + np.exp(-z[k * n : (k + 1) * n])) for k in range(3))
                cell = f * cell + i * np.tanh(z[3 * n :])
                state = o * np.tanh(cell)
                states[w, t] = state
        want = [1 / (1 + np.exp(-(np.concatenate([states["f", t], states["b", t], x[t]]) @ p["o"] + p["o1"][0]))) for t in range(len(page))]
        assert np.allclose(got, want, atol=1e-4)


def test_op10_no_or_one_class(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert T.scored(docs([(1, "a")]), T.trained(docs([(1, "a")]), none), keep=["doc_id"]).first().score < 1e-6
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id bigint, toxic int")
    assert T.scored(docs([(1, "a")]), T.trained(docs([(1, "a"), (2, "b")]), one), keep=["doc_id"]).first().score > 0.99
    assert T.scored(docs([]), (np.zeros(T.WIDTH, np.float32), 0.0), keep=["doc_id"]).count() == 0


# ---- html ------------------------------------------------------------------------------------------------------


def test_op7_blocks():
    page = '<title>no</title><nav><a href="/x">Me&amp;nu</a></nav><article><p>One<p>Two <b>bold</b>&nbsp; x<br>y</p>tail<!-- gone --><script>if (a<b) {}</script></article><div class="ad">Ad<'
    got = H.blocks(page)
    assert [b[0] for b in got] == ["Me&nu", "One", "Two bold x y", "tail", "Ad<"] and got[0][2] == 1.0
    assert got[1][1] == ("article", "p") and got[4][1] == ("div ad",)
    assert H.blocks("plain text") == [("plain text", (), 0.0)] and H.blocks("") == [] and H.blocks("<p") == []
    assert [b[0] for b in H.blocks("<p>cut off <a hre")] == ["cut off"]


def test_op7_gradients_are_right():
    r = np.random.Generator(np.random.PCG64(3))
    pages = [H.blocks(H.made_page(r)[0])[:6] for _ in range(3)]
    m = H.Labeller.fresh()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = np.zeros((6, 3, H.vectors(pages).shape[1]))
    mask = np.zeros((6, 3))
    at = 0
    for c, p in enumerate(pages):
        x[: len(p), c], mask[: len(p), c] = H.vectors(pages)[at : at + len(p)], 1
        at += len(p)
    y = r.integers(0, 2, (6, 3)).astype(float)

    def loss():
        z = m.logits(x, mask)[0]
        return (mask * (np.logaddexp(0, z) - y * z)).sum() / mask.sum()

    g = m.gradients(x, mask, y)
    for name in m.p:
        for k in r.integers(0, m.p[name].size, 3):
            w = m.p[name].reshape(-1)
            old = w[k]
            w[k] = old + 1e-4
            up = loss()
            w[k] = old - 1e-4
            down = loss()
            w[k] = old
            assert abs((up - down) / 2e-4 - np.asarray(g[name]).reshape(-1)[k]) < 1e-4


def test_op7_held_out_layouts_and_edges(spark):
    r = np.random.Generator(np.random.PCG64(77))
    made = [H.made_page(r) for _ in range(120)]
    rows = [(k, f"u{k}", p, "x") for k, (p, _) in enumerate(made)] + [(900, None, None, "x"), (901, "u", "", "x"), (902, "u", "<nav><a>only menu</a></nav>", "x"), (902, "u", "<nav><a>only menu</a></nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {x.page_id: x for x in H.extract(pages).collect()}
    right = 0
    for k, (p, labels) in enumerate(made):
        want = "\n".join(b[0] for b in H.blocks(p) if labels.get(b[0], 0))
        right += got[k].text == want
        assert got[k].n_chars == len(got[k].text)
    assert right / 120 > 0.9
    assert (got[900].text, got[901].text, got[900].url) == ("", "", None)
    assert H.extract(pages.limit(0)).count() == 0

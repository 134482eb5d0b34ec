"""The pipeline over a small corpus: every stage against what it should keep, and what run() gives against the stages in turn."""

import hashlib
import random
import re

import corpus_pipeline as C
from foliomill.llm import neardup, toxicity


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")


def corpus():
    r = random.Random(10)
    words = [f"w{''.join(r.choices('abcdef', k=4))}" for _ in range(300)]
    prose = lambda n: " ".join(r.choices(words, k=n))
    passage, item = prose(20), prose(25)
    rows = []
    for k in range(240):
        t = prose(r.randrange(20, 80))
        if k % 6 == 0:
            t += " grolk " + prose(3)
        rows.append([k, t, "en", r.choice(["a", "a", "b"])])
    for k in range(240, 260):
        rows.append([k, rows[k - 200][1] + " " + prose(2), "en", "b"])  # near copies
    for k in (1, 7, 13):
        rows[k][1] += "\n" + passage
        rows[k + 1][1] += "\n" + item
    rows += [[900, None, "en", "a"], [901, "", None, None]]
    rows = [(*x, len(x[1] or "")) for x in rows]
    return rows, [(x[0], 1, int("grolk" in (x[1] or ""))) for x in rows if x[0] % 5], [(1, item), (2, prose(12))], passage, item


def test_stages_and_run(spark, tmp_path):
    rows, labels, items, passage, item = corpus()
    write(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert 4 <= len(C.STAGES) <= 5 and [n for n, _ in C.STAGES][0] == "toxicity"

    clean = C.drop_toxic(spark, docs, str(tmp_path)).cache()
    assert clean.columns == C.COLUMNS
    toxic = {x[0] for x in rows if "grolk" in (x[1] or "")}
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in rows} - toxic
    assert clean.where("text is null").count() == 1

    single = C.one_of_each(spark, clean, str(tmp_path)).cache()
    kept = {r.doc_id for r in neardup.near_duplicates(clean).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == kept and single.columns == C.COLUMNS and single.count() < clean.count()

    cut = C.without_repeated_passages(spark, single, str(tmp_path)).cache()
    assert cut.columns == C.COLUMNS and cut.count() == single.count()
    assert sum(passage in (r.text or "") for r in cut.collect()) == 1
    assert all(r.n_chars == len(r.text or "") for r in cut.collect()) and cut.where("doc_id = 900 and text is null").count() == 1

    free = C.without_benchmark(spark, cut, str(tmp_path)).cache()
    assert free.columns == C.COLUMNS and free.count() == cut.count()
    windows = [" ".join(item.split()[i : i + 10]) for i in range(16)]
    assert not any(w in " ".join(re.findall(r"[a-z0-9]+", r.text or "")) for r in free.collect() for w in windows)
    before = {r.doc_id: r.text for r in cut.collect()}
    assert sum(before[r.doc_id] != r.text for r in free.collect()) <= 3

    last = {r.doc_id: r for r in C.mixed(spark, free, str(tmp_path)).collect()}
    assert len(last) == free.count()
    digest = lambda some: sorted(hashlib.md5(repr((r.doc_id, r.text, r.mix_slot, r.mix_position)).encode()).hexdigest() for r in some)
    assert digest(C.run(spark, str(tmp_path)).collect()) == digest(last.values())


def test_empty_table(spark, tmp_path):
    write(spark, tmp_path, [], [], [])
    assert C.run(spark, str(tmp_path)).count() == 0


def test_threshold_is_the_scores(spark, tmp_path):
    rows, labels, items, *_ = corpus()
    write(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.trained(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    low = toxicity.scored(docs, model, keep=["doc_id"]).where("score < 0.5").count()
    assert low == C.drop_toxic(spark, docs, str(tmp_path)).count()


def test_one_of_each_with_repeated_and_null_ids(spark, docs):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(3, b), (5, a), (5, b), (6, c), (6, c), (7, c + " more"), (None, d), (None, d + " more"), (None, d), (None, e), (9, e), (9, e + " more"), (None, None), (None, None), (8, "")]

    def alike(x, y):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for t in (x, y))
        return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)

    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if j == i or alike(rows[i][1], rows[j][1])) for i in range(len(rows))]
    want = []
    for g in set(group):
        of = [r for r, k in zip(rows, group, strict=True) if k == g]
        want.append(min((9999 if k is None else k) for k, _ in of))
    got = C.one_of_each(spark, docs(rows, extra=False), "").collect()
    assert sorted(9999 if r.doc_id is None else r.doc_id for r in got) == sorted(want) == [3, 5, 6, 8, 9, 9999, 9999, 9999]
    assert [r.text for r in got if r.doc_id == 5] == [a] and [r.text for r in got if r.doc_id == 3] == [b]

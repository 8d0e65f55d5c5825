"""The pipeline's stages, each against brute force on its own input, and the whole run."""

from collections import Counter

import corpus_pipeline as p
from test_contracts import AZ, SMALL, TOKEN, WORD, brute_components
from pyspark.sql import functions as F

from sievework.llm import near_dup


def rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    kept = p.keep_quality(spark, docs, SMALL).cache()
    assert kept.columns == list(p.COLUMNS) and 0 < kept.count() <= docs.count()
    poor = spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert poor.join(kept, "doc_id", "left_anti").count() <= 0.05 * poor.count()

    lines = p.drop_lines(spark, docs, SMALL).cache()
    assert lines.columns == list(p.COLUMNS) and lines.count() == docs.count() and lines.where(F.length("text") != F.col("n_chars")).count() == 0

    near = p.drop_near_duplicates(spark, lines, SMALL).cache()
    want = sorted(k[0] for k, n in brute_components(rows(lines), percent=80).items() if k[3] for _ in range(n))
    assert sorted(d for d, _ in rows(near)) == want

    bench = [WORD.findall((r["text"] or "").translate(AZ)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    wins = {tuple(w[i : i + 10]) for w in bench if w for i in range(max(1, len(w) - 9))}
    sizes = {len(x) for x in wins}

    def clean(t):
        w = WORD.findall(t.translate(AZ))
        return not any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1))

    left = p.drop_contaminated(spark, near, SMALL).cache()
    assert sorted(rows(left)) == sorted((d, t) for d, t in rows(near) if clean(t))

    mixed = p.mix(spark, left, SMALL).collect()
    size = Counter({d: len(TOKEN.findall(t)) for d, t in rows(left)})
    assert all(r["size"] == size[r["doc_id"]] and 0 < r["taken"] <= 3 * r["size"] for r in mixed)
    assert abs(sum(r["taken"] for r in mixed) - sum(size.values())) <= len({r["source_size"] for r in mixed}) * 2


def test_run_survives_odd_rows(spark, docs, tmp_path):
    docs.where("length(coalesce(text, '')) < 6000").select(*p.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = p.run(spark, str(tmp_path))
    assert out.count() > 0 and {"doc_id", "taken"} <= set(out.columns)
    empty = tmp_path / "empty"
    docs.limit(0).select(*p.COLUMNS).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, str(empty)).count() == 0


def test_near_duplicate_stage_links_from_80_percent(spark):
    base = [f"w{i}" for i in range(204)]  # 200 shingles; words apart by 5 or more take 5 shingles each
    edited = {1: (), 2: (20, 60, 100, 140), 3: (20, 60, 100, 140, 180)}
    texts = {d: " ".join(f"x{d}" if i in at else w for i, w in enumerate(base)) for d, at in edited.items()}
    texts |= {d + 10: " ".join(f"{d}{w}" for w in base) for d in range(3)}
    sets = {d: near_dup.shingles(t) for d, t in texts.items()}
    similar = {d: len(set(sets[1]) & set(sets[d])) / len(set(sets[1]) | set(sets[d])) for d in (2, 3)}
    assert 0.80 <= similar[2] < 0.85 and similar[3] < 0.80
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {d for d, _ in rows(p.drop_near_duplicates(spark, docs, SMALL))} == {1, 3, 10, 11, 12}
    assert near_dup.cluster(docs, percent=85).where("not kept").count() == 0


def test_bands_and_pruning_follow_the_threshold():
    assert near_dup.banding(85) == (6, 30) and near_dup.banding(80) == (5, 36)
    assert all(low[1] < high[1] for low, high in zip(near_dup.fewest_matches(0.8), near_dup.fewest_matches(0.85), strict=True))

"""The pipeline against a plain version on one small table."""

from collections import Counter

import numpy as np
import pandas as pd

import corpus_pipeline
from tests.llm.helpers import ODD
from turnloom.llm import decontam, langid

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(8)
    words = {"en": [f"the{i}" for i in range(300)], "de": [f"großund{i}" for i in range(300)]}
    rows = [(d, t, None, None, None) for d, t in ODD]
    items = [(i, " ".join(rng.choice(words["en"], 25)) + "?\n" + " ".join(rng.choice(words["en"], 6))) for i in range(8)]
    for i in range(240):
        lang = "de" if i % 3 == 0 else "en"
        text = " ".join(rng.choice(words[lang], rng.integers(30, 300)))
        if i % 15 == 1:
            text = text + " " + items[i // 15 % 8][1]
        rows.append((100 + i, text, lang, f"s{i % 4}", len(text)))
        if i % 10 == 0:
            rows.append((1000 + i, text if i % 20 else text.upper(), lang, "copy", len(text)))
            rows.append((2000 + i, text + " " + words[lang][i], lang, "near", len(text)))
    return rows, items


def test_stages_against_plain_version(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [tuple(r) for r in docs.collect()]
        if name != "shard":
            assert docs.columns == COLS

    def same(a, b):
        assert Counter(map(str, a)) == Counter(map(str, b))

    model = langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet").where(langid.held_out(5) == False).where("lang is not null"))  # noqa: E712
    lang = dict(zip([str(r) for r in rows], zip(*model.predict([r[1] or "" for r in rows]), strict=True), strict=True))
    want = [r for r in rows if lang[str(r)][0] != "und" and lang[str(r)][1] >= 0.5]
    same(kept["language_id"], want)

    words_of = [(r[1] or "").lower().split() for r in want]
    fps = [({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set(), r) for w, r in zip(words_of, want, strict=True)]
    group = list(range(len(fps)))
    for i, (a, _) in enumerate(fps):
        for j in range(i):
            if len(a & fps[j][0]) >= 0.8 * len(a | fps[j][0]) - 1e-9:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, (_, r) in zip(group, fps, strict=True):
        if g not in best or (r[0] is None, r[0] or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = r
    want = list(best.values())
    assert len(want) < len(fps)
    same(kept["near_dedup"], want)

    norm = lambda t: b" ".join(decontam.words(t))
    want = [r for r in want if not any(norm(t) in norm(r[1]) for _, t in items)]
    same(kept["decontaminate"], want)

    size = lambda r: len((r[1] or "").split())
    mixed, before = Counter(map(str, kept["mix"])), Counter(map(str, want))
    assert set(mixed) <= set(before) and all(n <= 2 for n in mixed.values())
    got = sum(size(r) for r in kept["mix"])
    assert abs(got / (1.5 * sum(map(size, want))) - 1) < 0.15

    shards = pd.DataFrame(kept["shard"], columns=["doc_id", "size", "crc", "law", "shard", "slot", "grown"])
    assert len(shards) == len(kept["mix"]) and shards.groupby("crc")["shard"].nunique().max() == 1
    assert all(sorted(g) == list(range(len(g))) for _, g in shards.groupby("shard")["slot"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r[0] for r in kept["shard"]}

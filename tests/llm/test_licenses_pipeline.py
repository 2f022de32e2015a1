"""License scans against planted wordings, and the pipeline against its stages' plain meaning."""

import hashlib
import re
import textwrap

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import bpe, licenses, mixing, neardup, pii

from .test_pii import plain

SCHEMA = "doc_id long, text string, licenses string, evidence int"
SF = "/root/testdata/sf0.001"


def test_every_template_is_found_in_noise(spark):
    noise = "alpha beta gamma delta epsilon "
    rows = [(k, f"{noise * 30}\n{noise} {t}. {noise}\n{noise * 10}", "x", 1) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, noise * 300 + t + " " + noise * 300, "x", 1) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r.licenses for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k + d: name for d in (0, 100) for k, (name, _) in enumerate(licenses.TEMPLATES)}


def test_other_versions_and_clean_texts_are_not(spark):
    rows = [(1, "Licensed under the Apache License, Version 1.1", None, 1), (2, "my driving license and permission slip", None, 1), (3, None, None, 1), (4, "", None, 1), (4, "", None, 1), (None, "Released under the MIT License.", None, 1), (5, "license " * 5000, None, 1)]
    got = sorted((r.doc_id or 0, r.licenses) for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, "MIT"), (1, ""), (2, ""), (3, ""), (4, ""), (4, ""), (5, "")]
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_wrapped_wordings_and_several_licenses_of_a_text(spark):
    wrapped = [(k, "code " * 40 + "\n" + "\n".join(" * " + x for x in textwrap.wrap(t, 60, break_on_hyphens=False)) + "\n */ code", "x", 1) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    two = "Licensed under the MIT License. Parts are Licensed under CC BY 4.0, others licensed under the Apache License, Version 2.0."
    many = " and then ".join(t for _, t in licenses.TEMPLATES)
    rows = [*wrapped, (100, two, "x", 1), (101, many, "x", 1), (102, "\n".join(["Released under the MIT License"] * 3), "x", 1), (103, "THIS IS FREE AND UNENCUMBERED SOFTWARE RELEASED INTO THE PUBLIC\nDOMAIN", "x", 1)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, (name, _) in enumerate(licenses.TEMPLATES):
        assert (got[k].licenses, got[k].n_matches) == (name, 1)
    assert (got[100].licenses, got[100].n_matches) == ("Apache-2.0,CC-BY-4.0,MIT", 3)
    assert [x.split(":")[0] for x in got[101].evidence.split(",")] == [name for name, _ in licenses.TEMPLATES]
    assert (got[102].licenses, got[102].n_matches) == ("MIT", 3)
    assert got[103].licenses == "Unlicense"


HEADERS = {
    "GPL-3.0": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.""",
    "BSD": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "Apache-2.0": "# SPDX-License-Identifier: Apache-2.0\n",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or
# modify it under the terms of the GNU Lesser General Public
# License as published by the Free Software Foundation; either
# version 2.1 of the License, or (at your option) any later version.""",
}


def test_headers_of_files(spark):
    rows = [(k, "some code here\n" * 50 + t + "\nmore code there\n" * 50, "x", 1) for k, t in enumerate(HEADERS.values())]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [(got[k].licenses, got[k].n_matches) for k in range(len(HEADERS))] == [(name, 1) for name in HEADERS]


def test_savings_rank_and_wording_decides():
    s = licenses.Scanner()
    block = licenses.word_list("it says licensed under the gnu general public license here: this work is licensed under the GNU Lesser General Public License, version 3 or so")
    ks = [k for k, (name, t) in enumerate(licenses.TEMPLATES) if t.startswith("This work is licensed under the GNU")]
    order = s.ranked(ks, block)
    assert [g for g, _ in order] == sorted((g for g, _ in order), reverse=True) and licenses.TEMPLATES[order[0][1]][0] == "LGPL-3.0"
    # GPL-3.0 would be confirmed as well, with a word in between, but saves less at the place
    assert s.scan(" ".join(block)) == [("LGPL-3.0", s.gain(order[0][1], s.words[order[0][1]]), 0)]


def test_long_texts_and_repeated_cues(spark):
    rows = [(1, "license copyright permission " * 40_000 + HEADERS["BSD"] + " filler" * 100_000 + " Released under the MIT License", "x", 1)] * 2
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.licenses, r.n_matches) for r in got] == [("BSD,MIT", 2)] * 2


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage took and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline._written(spark, stage(spark, docs, SF), name)
        out.append((docs, got))
        docs = got
    return out


def test_pipeline(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    for _, got in stages[:-1]:
        assert got.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    toxic, kept = stages[0]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = set(ids(kept))
    assert all(d in left for d in ids(toxic) if labels.get(d) == 0)
    before, after = stages[1]
    assert ids(after) == sorted(r.doc_id for r in neardup.near_duplicates(before, 80).where("kept").collect())
    before, after = stages[2]
    texts = {r.doc_id: r.text for r in after.collect()}
    for r in before.collect():
        assert not any(plain(texts[r.doc_id]).values())
        assert (texts[r.doc_id] == r.text) or any(plain(r.text).values()) or pii.find(before.where(F.col("doc_id") == r.doc_id)).first().n_added
    before, after = stages[3]
    times = {r.doc_id: (r.taken, r["size"]) for r in mixing.mix_report(before).collect()}
    assert ids(after) == sorted(d for d, (taken, size) in times.items() for _ in range(taken // size if size else 0))
    before, after = stages[4]
    enc = bpe.encoding(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), corpus_pipeline.public_tokenizers.PATTERN)
    want = sorted((r.doc_id, len(enc.encode_ordinary(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in before.collect())
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in after.collect()) == want
    assert re.fullmatch("[0-9a-f]{64}", after.first().ids_sha256)


def test_run_equals_stages(spark, stages):
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(corpus_pipeline.run(spark, SF)) == rows(stages[-1][1])


def test_pipeline_over_odd_rows(spark, tmp_path, monkeypatch):
    text = lambda k: f"some words number {k} of a text that is long enough to have shingles of its own {k * 7} and {k * 13}"
    rows = [(k, text(k), "en", ["a", "b", None][k % 3]) for k in range(60)] + [(3, text(3), "en", "a"), (None, text(90), None, None), (None, None, None, None), (61, None, "en", "a"), (62, "", "de", "b"), (63, " \n ", None, "b"), (64, "word " * 60_000 + "mail me: anna@example.org now", "en", "a")]
    rows = [(*r, 1, "_", 2.0, 3, "k", 5, 6, "x") for r in rows]
    schema = "doc_id long, text string, lang string, source string, y long, _id string, share double, size long, key string, _gone long, copies long, row string"
    for name, part in (("full", rows), ("none", [])):
        home = tmp_path / name
        spark.createDataFrame(part, schema).write.parquet(f"{home}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(40)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
        docs = spark.read.parquet(f"{home}/documents.parquet")
        for stage, f in corpus_pipeline.STAGES:
            got = f(spark, docs, str(home))
            if stage != "byte_bpe":
                assert got.columns == docs.columns
                docs = corpus_pipeline._written(spark, got, stage)
            if stage == "pii":
                assert docs.count() == len(part) and not docs.where("text like '%anna@%'").count()
        assert {r.doc_id for r in got.collect()} <= {r[0] for r in part} and (got.count() > 0) == bool(part)
    monkeypatch.setattr(corpus_pipeline, "_home", lambda _, to=f"{tmp_path}/kept": to)
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 0
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("kept")) == ["kept-mixing"]

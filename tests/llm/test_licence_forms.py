"""Every form of every licence: full texts, SPDX lines and headers."""
from partweave.llm import licenses


def test_licence_forms(spark):
    rows = [(f"{name}: text", f"Copyright 2021 Some Holder\n{text}", name) for name, text in licenses.full_texts().items()]
    rows += [(f"{i}: spdx", f"# SPDX-License-Identifier: {i}", name) for name, ids in licenses.SPDX_IDS.items() for i in ids]
    rows += [(f"{name}: notice {n}", text, name) for name, of in licenses.NOTICES.items() for n, text in enumerate(of)]
    rows += [("spdx and holder", "/* Copyright (c) 2020 Some Holder\n * SPDX-License-Identifier: MPL-2.0 */", "MPL-2.0"),
             ("unknown id", "SPDX-License-Identifier: Zlib", None), ("prose", "they lost their driving licence in the rain", None)]
    frame = spark.createDataFrame([r[:2] for r in rows], "k string, notice string")
    found = {r["notice"]: r["licence"] for r in licenses.own_licences(frame, licenses.all_templates(), 0.5).collect()}
    assert {k: found.get(t) for k, t, _ in rows} == {k: name for k, _, name in rows}
    docs = spark.createDataFrame([(1, "a/LICENSE", licenses.full_texts()["Apache-2.0"]), (2, "a/b/x.py", "code")], "doc_id long, path string, text string")
    assert {r["doc_id"]: r["licence"] for r in licenses.licence_scan(docs).collect()} == {1: "Apache-2.0", 2: "Apache-2.0"}

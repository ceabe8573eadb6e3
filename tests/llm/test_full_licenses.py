"""Full licence texts, and lines of any length."""

from __future__ import annotations

import textwrap

from folio.llm.full_licenses import full_texts
from folio.llm.license_scan import known_digests, scan_licenses
from folio.llm.license_texts import KNOWN, MIT_BODY


def test_full_texts_are_known(spark):
    texts = full_texts()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {n for n, _ in texts}
    messy = [(k, "Copyright (c) 2020 Somebody\n" + t.replace(" the ", "  the\t").replace("license", "licence")) for k, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.licence for r in scan_licenses(spark.createDataFrame(messy, "doc_id long, text string"), known_digests(spark)).collect()}
    assert got == {k: n for k, (n, _) in enumerate(texts)}


def test_lines_of_any_length(spark):
    notice = "Licensed to whom it may concern, " + ", ".join(f"for use number {k}" for k in range(40)) + "."
    docs = spark.createDataFrame([(1, f"Prose.\n{notice}\nMore prose.")], "doc_id long, text string")
    assert len(notice) > 500 and scan_licenses(docs, known_digests(spark, (("Own", notice),))).collect()[0].line_licences == "Own"


def test_wrapping_does_not_matter(spark):
    """Every known text at widths 60 to 80 and on one line, alone and, the short ones, under a holder's line."""
    rows, want = [], {}

    def add(name: str, text: str) -> None:
        rows.append((len(rows), text))
        want[len(rows) - 1] = name

    for name, text in KNOWN + full_texts():
        one = " ".join(text.split())
        add(name, one)
        for width in range(60, 81, 1 if len(text) < 5_000 else 7):
            wrapped = textwrap.fill(one, width)
            add(name, wrapped)
            if (name, text) in KNOWN:
                add(name, f"# Copyright 2021 The Authors\n{wrapped}")
                add(name, f"Copyright (c) 2019-2021 Some One, Some Where\n(c) 2022 Another\nAll rights reserved.\n\n{wrapped}")
    for start in ("Copyright (c) 2020 Foo. ", "(C) 2020 Foo, Inc. All rights reserved. ", " * Copyright © 2020 Foo.  "):
        add("MIT", start + " ".join(MIT_BODY.split()))
    got = {r.doc_id: r.licence for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_digests(spark)).collect()}
    assert {k: (got[k], rows[k][1][:80]) for k in want if got[k] != want[k]} == {}

"""Known licence texts in other wrappings; only copyright statements are taken out."""

import textwrap

from tidemark.llm import license_scan
from tidemark.llm.license_texts import TEXTS

ISC_PUBLISHED = """Copyright (c) 2004-2010 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

"""


def test_wrapped_texts(spark):
    isc = next(b for i, _, b in TEXTS if i == "ISC")
    rows = [("ISC", ISC_PUBLISHED + textwrap.fill(isc.split("\n")[1], 78))]
    for licence, _, body in TEXTS:
        for width in (20, 40, 60, 72, 79, 100):
            wrapped = "\n".join(textwrap.fill(x, width, break_on_hyphens=False, break_long_words=False) for x in body.split("\n"))
            rows += [(licence, wrapped)] + [(licence, f"{head}\n\n{wrapped}") for head in ("Copyright 2019 X", "# copyright by X", "Copyright X, 2011", "Portions Copyright © X\nAll rights reserved.")]
        words = body.replace("copyright", "\ncopyright").replace("COPYRIGHT", "\nCOPYRIGHT")
        rows.append((licence, words))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in license_scan.scan(docs).collect()}
    assert [got[i] for i in range(len(rows))] == [x for x, _ in rows]

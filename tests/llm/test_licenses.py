import hashlib
import re

from binfall.llm import licenses


def canonical(text):
    text = re.sub(r"(?im)^[^\w\n]*(?:copyright\b|\(c\)\s|\xa9)[^\n]*$", " ", text or "")
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return " ".join(dict(licenses.SPELLINGS).get(w, w) for w in words)


def digest(text):
    return hashlib.sha256(canonical(text).encode()).hexdigest()


TABLE = {digest(t): i for i, t in licenses.KNOWN}
MIT = dict(licenses.KNOWN[:1])["MIT"]
TEXTS = [
    None,
    "",
    " .,; ",
    MIT,
    "MIT LICENCE\n\nCopyright (c) 2020 Someone\n(C) 2021 Other\n© Third\n" + MIT.upper().replace(" ", "\n", 40).replace("SUBLICENSE", "sublicense"),
    "x " + MIT,
    "Some words.\nReleased under the  MIT licence!\nmore\nAll rights reserved.\nreleased under the mit license",
    "prose Released under the MIT License. in a line",
    "Licensed under the Apache License, Version 2.0.\nTh ndinly",
    "This work is licenced under the\nGNU",
    "licence " * 20_000,
    "a\nAll rights  reserved.\nb",
    "All-rights-reserved",
    "x\nreleased... under [the] MIT\tlicence\n",
]


def test_against_a_plain_lookup(spark, documents):
    rows = {r.doc_id: r for r in licenses.scan(documents(TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert rows[i].text_digest == digest(t)
        assert rows[i].license_id == TABLE.get(digest(t))
        want = sorted({TABLE[d] for d in map(digest, (t or "").split("\n")) if d in TABLE})
        assert rows[i].notices == ",".join(want) and rows[i].n_notices == len(want), (t, want)
    assert rows[3].license_id == rows[4].license_id == "MIT" and rows[5].license_id is None


def test_every_known_text_is_found(spark, documents):
    found = {r.doc_id: r.license_id for r in licenses.scan(documents([t for _, t in licenses.KNOWN])).collect()}
    assert [found[i] for i in range(len(found))] == [i for i, _ in licenses.KNOWN]


def test_empty_table_and_clashing_columns(spark, documents):
    assert licenses.scan(documents([])).count() == 0
    odd = spark.createDataFrame([(1, "All rights reserved", 5, "c"), (1, "All rights reserved", 6, "d")], "doc_id long, text string, digest int, line string")
    assert [r.notices for r in licenses.scan(odd).collect()] == ["LicenseRef-Proprietary"] * 2


def test_full_texts_later_versions_and_a_table_of_ones_own(spark, documents):
    texts = [open(f"/usr/share/common-licenses/{x}", encoding="utf-8").read() for x in ("Apache-2.0", "GPL-3", "MPL-2.0")]
    texts += ["prose\nSPDX-License-Identifier: LGPL-2.1-or-later\n", "This work is licensed under the GNU General Public License, version 3 or any later version.", "x\nFree for all!"]
    got = sorted(licenses.scan(documents(texts)).collect())
    assert [r.license_id for r in got] == ["Apache-2.0", "GPL-3.0-only", "MPL-2.0", None, "GPL-3.0-or-later", None]
    assert [r.notices for r in got[3:]] == ["LGPL-2.1-or-later", "GPL-3.0-or-later", ""]
    own = spark.createDataFrame([("Own", "free for ALL"), ("Z", "free for all."), ("E", " .")], "license_id string, text string")
    got = sorted(licenses.scan(documents([*texts, ""]), own).collect())
    assert [r.notices for r in got] == [""] * 5 + ["Own", ""] and got[-1].license_id is None


def test_rows_without_an_id_keep_their_notices(spark, documents):
    rows = licenses.scan(documents([(None, "x\nAll rights reserved.", "s"), (None, "y", "s"), (1, "z", "s")])).collect()
    assert sorted((r.doc_id is None, r.notices, r.n_notices) for r in rows) == [(False, "", 0), (True, "", 0), (True, "LicenseRef-Proprietary", 1)]

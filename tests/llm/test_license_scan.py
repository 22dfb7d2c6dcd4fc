import re

from wirefold.llm.license_scan import NOTICES, PHRASES, scan_licenses

SCHEMA = "doc_id long, text string, labels string, pos string"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for phrase, label in PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_and_notices(spark):
    texts = [
        None, "", "...", "MIT", "MIT License", "mit-license mit license, MIT\nLICENSE!", "the CC BY-NC 4.0 and cc by", "cc  by", "xcc by", "été CC BY é",
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.",
        "filler " * 5000 + "Released under the MIT License. " * 300, "apache apache license license", "gnu general public gnu general public license",
        "Released under a very permissive MIT license", "Licensed under the new Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "of the in the",
    ]
    rows = [(i, t, "clash", "kept") for i, t in enumerate(texts)] + [(4, "MIT License", "", "kept")]
    out = scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(r.text), r.text
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and r.pos == "kept"
    labels = {r.doc_id: r.labels for r in out}
    assert labels[10] == labels[16] == "apache,apache-2.0"
    assert labels[11] == "gpl,gpl-3.0" and labels[17] == "cc-by,cc-by-nc-4.0" and labels[18] == ""
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_notice_is_found(spark):
    rows = [(i, f"some words before {t} and after", "", "") for i, (t, _) in enumerate(NOTICES)]
    out = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (t, label) in enumerate(NOTICES):
        mine = [s for s in out[i].spans if s.label == label]
        assert mine and max(s.similarity for s in mine) == 1.0 and min(s.first_word for s in mine) <= 3

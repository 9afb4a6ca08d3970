"""License scan: spellings, copyright lines, whole texts and lines only."""

import hashlib
import random
import re

from formweave.llm import licenses as L
from formweave.llm.license_texts import SPELLINGS, TEXTS, known

SCHEMA = "doc_id long, text string, digest string, license string, line_licenses string"
MIT = TEXTS[0][1]


def canonical(text):
    t = re.sub(r"(^|\n)[^\n\w]*(copyright[ \t]*(\(c\)|©|[0-9]{4})|©|\(c\)[ \t]*[0-9]{4})[^\n]*", r"\1", (text or "").lower())
    t = re.sub(r"(^|\n)[^\n\w]*all rights reserved[^\n\w]*(\n|$)", r"\1\2", t)
    t = "\n".join(re.sub(r"[\W_]+", " ", x) for x in t.split("\n")) + " "
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return [x.strip() for x in t.split("\n") if x.strip()]


def sha(parts):
    return hashlib.sha256(" ".join(parts).encode()).hexdigest()


def wrapped(text, width):
    out, line = [], ""
    for w in text.split(" "):
        line, out = (w, [*out, line]) if len(line) + len(w) > width else (f"{line} {w}".strip(), out)
    return "\n".join([*out, line])


def test_spellings(spark):
    same = [MIT, MIT.upper(), "Copyright (c) 2021 A. Person\n\n" + MIT, "  * " + wrapped(MIT, 60).replace("\n", "\n  * "), MIT.replace('"', "''"), "© 2020 x\nAll rights reserved.\n" + MIT.replace("sublicense", "sub-license"), MIT + "\r\n\r\n"]
    other = [MIT[:-30], "x " + MIT, "", None, MIT.replace("free of charge", "for a charge")]
    rows = [(i, t, None, "x", None) for i, t in enumerate(same + other)]
    got = {r.doc_id: r.license for r in L.scan(spark.createDataFrame(rows, SCHEMA), L.catalogue(spark)).collect()}
    assert [got[i] for i in range(len(rows))] == ["MIT"] * len(same) + [None] * len(other)


def test_lines_and_brute_force(spark):
    rng = random.Random(1)
    notices = ["Released under the MIT License.", "LICENSED under CC BY-NC 4.0", "licensed under the apache licence, version 2.0!", "This work is licensed under the GNU General Public License, version 3."]
    texts = ["\n".join(rng.choice([*notices, "Ünrelated « text »", "", "see Released under the MIT License."]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += [None, "", "word " * 50000 + "\n" + notices[0], *(t for _, t in TEXTS)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, notices[0], None, None, None), (3, notices[1], None, None, None), (4, texts[4], None, None, None)]
    codes = {}
    for name, t in sorted(known(), reverse=True):
        codes[sha(canonical(t))] = name
    want = sorted(((i, sha(canonical(t)), codes.get(sha(canonical(t))), sorted({codes[sha([x])] for x in canonical(t) if sha([x]) in codes})) for i, t, *_ in rows), key=str)
    got = [(r.doc_id, r.digest, r.license, r.line_licenses) for r in L.scan(spark.createDataFrame(rows, SCHEMA).repartition(3), L.catalogue(spark)).collect()]
    assert sorted(got, key=str) == want
    assert any(len(w[3]) > 1 for w in want)


def test_catalogues_and_empty(spark):
    docs = spark.createDataFrame([(1, "some terms", None, None, None)], SCHEMA)
    known_rows = spark.createDataFrame([("B", "Some terms!"), ("A", "some  terms"), ("C", None), ("D", "...")], "license string, text string")
    assert [r.license for r in L.scan(docs, known_rows).collect()] == ["A"]
    assert [r.license for r in L.scan(docs, known_rows.limit(0)).collect()] == [None]
    assert L.scan(docs.limit(0), known_rows).collect() == []
    plan = L.scan(docs, L.catalogue(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

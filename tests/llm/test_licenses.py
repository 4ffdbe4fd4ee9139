import random
import re

import numpy as np
import pyarrow as pa
import pytest
from lodeseam.llm import licenses

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(text, templates, containment):
    """The names found in the same windows by containment alone."""
    words, found = split(text), set()
    for name, template in templates.items():
        wanted = shingles(split(template))
        half = 1
        while half * 2 < len(split(template)) - 4:
            half *= 2
        for low in range(0, max(0, len(words) - 4), half):
            if len(wanted & shingles(words[low : low + 3 * half + 4])) >= containment * len(wanted):
                found.add(name)
    return found


def corpus():
    r = random.Random(4)
    filler = lambda n: [r.choice(["the", "of", "licensed", "under", "wörd", "License", "2.0", "é"]) + r.choice(["", ",", "."]) for _ in range(n)]
    texts = []
    for _ in range(160):
        words = filler(r.randint(0, 80))
        for _ in range(r.randint(0, 2)):
            notice = r.choice(list(licenses.TEMPLATES.values())).split()
            for _ in range(r.randint(0, 3) if len(notice) > 20 else 0):
                notice[r.randrange(len(notice))] = "changed"
            words += notice + filler(r.randint(0, 60))
        texts.append(r.choice([" ", "\n"]).join(words))
    return texts + [None, "", "Licensed under", "LICENSED UNDER THE APACHE LICENSE -- VERSION 2.0", " ".join(filler(30_000)) + " Licensed under CC BY-NC 4.0."]


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "y")], "doc_id long, text string, matches string")
    got = {r.doc_id: r.matches for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        assert {m.name for m in got[k]} == brute(t, licenses.TEMPLATES, 0.8), t
    assert sum(map(len, got.values())) > 100
    last = got[len(texts) - 1][-1]
    assert split(texts[-1])[last.first : last.last] == split("Licensed under CC BY-NC 4.0")
    assert len(brute(texts[-2], licenses.TEMPLATES, 0.8)) == 1


def test_unfit_templates_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(docs).collect() == []
    with pytest.raises(ValueError):
        licenses.scan(docs, {"x": "too short"})
    for half, wanted in licenses.Templates(licenses.TEMPLATES, 0.8).by_half.items():
        for name, _ in wanted:
            n = len(np.unique(licenses.Templates(licenses.TEMPLATES, 0.8).sets[name]))
            assert (1 - licenses.window_similarity(n, half, 0.8)) ** licenses.BANDS < 1e-5
    assert licenses.scan_batch(pa.array(["a b"]), licenses.Templates(licenses.TEMPLATES, 0.8)) == [[]]


GPL = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
SAID = {
    "licensed under the MIT License": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under Apache License 2.0": "Apache-2.0",
    "Licensed under the Apache License, Version 1.1.": "Apache-1.1",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "released under the terms of the GPLv3 or later": "GPL-3.0",
    "Licensed under the GNU General Public License, version 7.": "GPL",
    "Licensed under the GPL, version 3.5 of 2040.": "GPL",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1",
    "distributed under a Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0",
    "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
    GPL.format("General ", "2"): "GPL-2.0",
    GPL.format("General ", "3"): "GPL-3.0",
    GPL.format("Lesser General ", "2.1"): "LGPL-2.1",
    GPL.format("Affero General ", "3"): "AGPL-3.0",
    GPL.format("General ", "2") + " " + GPL.format("Lesser General ", "3"): "GPL-2.0,LGPL-3.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "BSD",
    "a license to wander, under the apache of the gnu": "",
}


def test_wordings_that_are_no_templates(spark, tmp_path):
    bsd = licenses.covered()[0]["BSD-3-Clause:text"]
    rows = dict(SAID) | {bsd: "BSD-3-Clause", bsd.replace("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. ", ""): "BSD-2-Clause"}
    full = licenses.covered()[0]["GPL-2.0:text"]
    rows |= {full: "GPL-2.0", "x " * 300 + full.replace("Activities", "Things") + " and licensed under the ISC License": "GPL-2.0,ISC"}
    texts = list(rows)
    spark.createDataFrame([(k, f"Word before. {t}\nand after") for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {texts[r.doc_id]: r.licenses for r in licenses.op1_license_scan(spark, str(tmp_path)).collect()}
    assert got == rows


def test_columns_of_the_query(spark, tmp_path):
    r = random.Random(12)
    texts, deciding = licenses.notices.notices()
    names = sorted(n for n in texts if len(split(texts[n])) > 40)
    rows, planted = [], {}
    for k in range(240):
        name = r.choice(names)
        notice = split(texts[name])
        for _ in range(r.randint(0, len(notice) // 60)):  # a changed word costs five shingles at most
            notice[r.randrange(len(notice))] = "changed"
        before, after = (" ".join(r.choices(["wörd", "lorem", "ipsum", "dolor"], k=r.randint(0, 200))) for _ in range(2))
        rows.append((k, f"{before} {' '.join(notice)} {after}", "x", 1))
        wanted = shingles(split(texts[name]))
        held = len(wanted & shingles(notice)) / len(wanted)
        if held >= 0.8 and all(f" {' '.join(split(p))} " in f" {' '.join(notice)} " for p in deciding.get(name, ())):
            planted[k] = name
    rows += [(900, None, None, None), (901, "", "", 2), (3, rows[3][1], "again", 3), (None, rows[5][1], "no id", 4)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, n_matches int").write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op1_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {g.doc_id: g for g in got}
    said = {d: split(t) for d, t, _, _ in rows}
    found = 0
    for g in got:
        spans = [(s.rsplit(":", 2)[0], *map(int, s.rsplit(":", 2)[1:])) for s in g.spans.split(",") if s]
        assert len(spans) == g.n_matches and g.licenses == ",".join(sorted({n.split(":")[0] for n, _, _ in spans}))
        shares = []
        for name, low, high in spans:  # what is said to be there is there
            if name in texts:
                wanted = shingles(split(texts[name]))
                shares.append(len(wanted & shingles(said[g.doc_id][low:high])) / len(wanted))
                assert shares[-1] >= 0.8
            else:
                shares.append(1.0)
        # a shingle that a notice says twice counts at the place of the copy alone
        assert max(shares, default=0.0) - 0.01 <= g.containment <= max(shares, default=0.0) + 2e-6 and (not shares or g.containment >= 0.8)
        assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    for k, name in planted.items():  # and what was planted is found, by this notice or by one of the same license that holds more
        found += name.split(":")[0] in by_id[k].licenses.split(",")
    assert len(planted) > 150 and found == len(planted)
    assert (by_id[900].n_matches, by_id[901].spans, by_id[901].containment) == (0, "", 0.0)

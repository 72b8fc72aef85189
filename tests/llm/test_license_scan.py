import random
import re

from evidentia.llm.license_scan import PHRASES, TEMPLATES, scan, words_of

TEXTS = [
    None, "", "MIT License", "mit license mit license", "the GNU  General-Public LICENSE, v3\nApache\nLicense", "ééMIT license", "mit licenses", "CC BY-NC 4.0",
    "Released under the MIT License.", "released, UNDER a mit license", "Licensed under the Apache License, Version 2.0.", "x" * 5000 + " cc by", "K mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this program and associated documentation", "cc\x00by İ",
    "under the license\nreleased mit", "this work is licensed under the gnu public general license version 3",
]


def brute(text):
    w = words_of(text or "")
    spots = [(i, label) for p, label in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, best = set(), 0.0
    for line in (text or "").split("\n"):
        b = set(words_of(line))
        for label, t in TEMPLATES:
            t = set(words_of(t))
            if len(t & b) >= 0.8 * len(t) - 1e-9:
                labels.add(label)
                best = max(best, len(t & b) / len(t))
    base = {x for _, x in spots}
    at = [i for i, _ in spots]
    return len(w), len(spots), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if spots else best


def corpus():
    r = random.Random(9)
    out = list(TEXTS)
    for _ in range(80):
        lines = []
        for _ in range(r.randrange(5)):
            w = words_of(r.choice(TEMPLATES)[1]) if r.random() < 0.6 else [r.choice(["the", "license", "mit", "foo"]) for _ in range(9)]
            w = [x for x in w if r.random() > 0.12]
            r.shuffle(w) if r.random() < 0.3 else None
            lines.append(r.choice([" ", ", "]).join(w))
        out.append("\n".join(lines))
    return out


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, labels string").repartition(3)
    got = scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6], repr(rows[r.doc_id])
        assert abs(r.score - want[6]) < 1e-9


def test_empty_and_repeated(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "mit license")] * 2, "doc_id long, text string")
    assert [r.n_base for r in scan(df).collect()] == [1, 1]
    assert not re.search(r"\s", brute("MIT License")[4])


def test_notices_that_wrap(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software"
    bsd = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:"
    gpl = "# This program is free software: you can redistribute it and/or modify\r\n# it under the terms of the GNU General Public License as published by\r\n# the Free Software Foundation, either version 3"
    far = "\n".join(["some other words of the text"] * 40)
    scattered = "\n".join(reversed(mit.split()))
    cut = mit.replace("copy\n", "copy\n\n")
    rows = list(enumerate([mit, bsd, gpl, f"{far}\n{mit}\n{far}", scattered, cut]))
    got = {r.doc_id: (r.labels, r.score) for r in scan(spark.createDataFrame(rows, "doc_id long, text string"), phrases=()).collect()}
    assert got == {0: ("mit-grant", 1.0), 1: ("bsd-notice", 1.0), 2: ("gpl-or-later-notice", 1.0), 3: ("mit-grant", 1.0), 4: ("", 0.0), 5: ("", 0.0)}

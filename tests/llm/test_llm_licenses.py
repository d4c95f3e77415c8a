import random
import re

import numpy as np
import pytest

from hashloom.llm import licenses as L
from hashloom.llm.license_texts import HELD_OUT, OTHER
from llm_data import awkward, documents, prose


@pytest.fixture(scope="module")
def model():
    rng = random.Random(10)
    return L.fit_model([prose(rng, rng.randint(5, 40)) for _ in range(600)])


def corpus():
    rng = random.Random(11)
    rows, planted = [], {}
    families = list(L.TEMPLATES)
    for i in range(150):
        lines = [prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))]
        if i % 2:
            family = families[i % len(families)]
            at = rng.randrange(len(lines) + 1)
            lines.insert(at, rng.choice(L.TEMPLATES[family]).capitalize() + ".")
            planted[i, at] = family
        rows.append((i, "\n\n".join(lines)))
    return rows, planted


def test_planted_lines_are_found(spark, model):
    rows, planted = corpus()
    got = {(r.doc_id, r.paragraph): r for r in L.scan(documents(spark, rows), model).collect()}
    right = sum(k in got and got[k].family == f and got[k].confirmed for k, f in planted.items())
    assert right >= 0.95 * len(planted)
    assert not [k for k, r in got.items() if r.confirmed and k not in planted]


def test_look_alikes_are_not_confirmed(spark, model):
    rows = [(k, t) for k, t in enumerate(L.LOOKALIKES)]
    assert not [r for r in L.scan(documents(spark, rows), model).collect() if r.confirmed]


def test_every_window_judged_alone(spark, model):
    """All windows of all paragraphs, feature by feature and with no bound, against what the scan finds."""
    rng = random.Random(12)
    rows, _ = corpus()
    rows += [(900 + k, " ".join([prose(rng, n), L.TEMPLATES["mit"][4], prose(rng, 300), L.TEMPLATES["gpl"][1]])) for k, n in enumerate((0, 60, 63, 64, 65, 127, 128, 400))]
    weight = {w: model.weights[k] for k, w in enumerate(model.words)}
    v = len(model.words)
    weight |= {(model.words[k // v], model.words[k % v]): model.weights[v + n] for n, k in enumerate(model.pair_keys)}
    want = {}
    for i, text in rows:
        for p, part in enumerate(re.split(r"\n\s*\n", text)):
            words = L.plain_words(part)
            for lo in range(0, max(1, len(words) - L.WIDTH // 2), L.WIDTH // 2):
                w = words[lo : lo + L.WIDTH]
                z = model.weights[-1] + sum((weight[f] for f in {*w, *zip(w, w[1:])} if f in weight), 0 * model.weights[-1])
                pr = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                family = L.FAMILIES[int(pr.argmax())]
                if family != L.UNKNOWN:
                    s = L.similarity(w, family)
                    new = (s >= model.min_similarity, s, float(pr.max()))
                    want[i, p, family] = max(want.get((i, p, family), new), new)
    got = {(r.doc_id, r.paragraph, r.family): (r.confirmed, r.similarity, r.probability) for r in L.scan(documents(spark, rows), model).collect()}
    assert got.keys() == want.keys()
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-9 for k, a in got.items() for b in [want[k]])
    assert all((900 + k, 0, f) in got and got[900 + k, 0, f][0] for k in range(8) for f in ("mit", "gpl"))


MIT = """Copyright (c) 2021 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
GPL = """You should have received a copy of the GNU General
Public License along with it. See the GNU General
Public License for more details."""


@pytest.mark.parametrize(
    "text, family",
    [
        (MIT, "mit"),
        (ISC, "isc"),
        (APACHE, "apache-2.0"),
        (BSD, "bsd"),
        (GPL, "gpl"),
        ("This page is licensed under CC BY-SA 4.0 by its authors.", "cc-by-sa"),
        ("This page is licensed under CC BY 4.0.", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("The Unlicense\n\nThis is free and unencumbered software released into the public domain.", "public-domain"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", "mpl-2.0"),
        ("It is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl"),
        ("It is licensed under the GNU Affero General Public License, version 3.", "agpl"),
    ],
)
def test_licence_texts(model, text, family):
    for t in (text, text.upper(), f"{prose(random.Random(1), 30)}\n\n{text}"):
        found = {v[0] for _, _, v in L.Scanner(model).scan([t]) if v[3]}
        assert found == {family}


def test_licences_of_no_family_are_unknown(model):
    """Those that no weight has seen, and one that nothing has."""
    seen = [t for name in sorted(HELD_OUT) for t in OTHER[name]] + ["Licensed under the Open Software License version 3.0.", "This file is distributed under the Zope Public License 2.1."]
    wrong = [(t, v) for t in seen for _, _, v in L.Scanner(model).scan([t]) if v[3]]
    assert not wrong


def test_probabilities_are_calibrated(model):
    """On lines varied by another seed, the mean probability of the predicted class is near how often it is right."""
    rng = random.Random(99)
    filler = prose(rng, 500).split()
    p, right = [], []
    number = {w: k for k, w in enumerate(model.words)}
    v = len(number)
    place = {k: v + n for n, k in enumerate(model.pair_keys)}
    for family, ts in (*L.TEMPLATES.items(), *((L.UNKNOWN, OTHER[n]) for n in sorted(HELD_OUT))):
        for t in ts:
            for _ in range(6):
                ids = [number.get(w, -1) for w in L._varied(L.plain_words(t), filler, rng)]
                f = sorted({x for x in ids if x >= 0} | {place[k] for a, b in zip(ids, ids[1:]) if a >= 0 <= b and (k := a * v + b) in place})
                z = model.weights[f].sum(axis=0) + model.weights[-1]
                q = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                p.append(q.max())
                right.append(L.FAMILIES[int(q.argmax())] == family)
    assert np.mean(right) >= 0.9 and abs(np.mean(p) - np.mean(right)) < 0.06


def test_awkward_rows(spark, model):
    line = "Released under the MIT license."
    rows = [*awkward(), (None, line), (20, line), (20, line), (21, f"{line}\n\n{line}")]
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in L.scan(documents(spark, rows, clashing=True), model).collect()), key=str)
    assert got == sorted([(None, 0, "mit"), (20, 0, "mit"), (20, 0, "mit"), (21, 0, "mit"), (21, 1, "mit")], key=str)
    assert L.scan(documents(spark, []), model).count() == 0


def test_training_on_a_table(spark):
    rows, _ = corpus()
    assert L.train(documents(spark, rows)).words
    assert L.train(documents(spark, [])).words

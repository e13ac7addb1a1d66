from __future__ import annotations

import random

from orewright.llm import licences


def slow(text):
    words = licences.words_of(text or "")
    pairs, found = [f"{a} {b}" for a, b in zip(words, words[1:])], []
    for k, (name, t) in enumerate(sorted(licences.TEMPLATES)):
        want, width = set(licences.bigrams_of(t)), len(licences.words_of(t)) - 1
        last = max(0, len(pairs) - width)
        best = (0, 0)
        for at in sorted({min(i, last) for i in range(0, last + licences.step_of(width + 1), licences.step_of(width + 1))}):
            own = set(pairs[at : at + width])
            if own and (d := 2 * len(own & want) / (len(own) + len(want))) > best[0]:
                best = (d, at)
        if best[0] >= 0.8:
            found.append((-best[0], -len(want), k, name, best[1], best[1] + min(width, len(pairs)) + 1))
    kept = [m for m in found if not any(o < m and o[4] < m[5] and m[4] < o[5] for o in found)]
    top = min(kept, default=None)
    return (top and top[3], round(-top[0], 6) if top else 0.0, len(kept), ",".join(sorted({m[3] for m in kept})))


def test_matches_brute_force(spark):
    rng = random.Random(2)
    lines = [t for _, t in licences.TEMPLATES]
    texts = [None, "", "one", "\n\n", "a b\n" * 500, "x " * 20_000]
    for t in lines:
        words = t.split()
        texts += [t, t.upper() + "!!", "Intro line.\n" + t + "\nmore", "pre " + t, t + " " + "tail " * 3, " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :])]
        words[rng.randrange(len(words))] = "über"
        texts.append(" ".join(words) + "\n\n" + rng.choice(lines))
    texts += [". ".join([t, "Some words stand between them", rng.choice(lines)]) for t in lines[::3]]
    rows = [(k, t, "MIT") for k, t in enumerate(texts)] + [(None, lines[0], "x"), (3, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence string").repartition(3)
    got = licences.scan(df).collect()
    assert len(got) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in got:
        assert tuple(r[1:]) == slow(by[r.doc_id]), by[r.doc_id]


def test_empty_and_own_templates(spark):
    df = spark.createDataFrame([(1, "do what you like with it")], "doc_id long, text string")
    assert licences.scan(df.limit(0)).count() == 0
    assert licences.scan(df, templates=[("OWN", "Do what you like with it!")]).first().licence == "OWN"
    assert licences.scan(df, templates=[]).first().n_matches == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = licences.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "Arrow" not in plan


def test_whole_licences_and_notices_inside_other_text(spark):
    by = {}
    for name, t in licences.TEMPLATES:
        by.setdefault(name, []).append(t)
    mit = max(by["MIT"], key=len)
    first = mit.split(", subject")[0] + ", subject to the following conditions:"
    texts = [
        ("MIT", "Copyright (c) 2020 Somebody\n\n" + mit.replace(". ", ".\n\n").replace(", ", ",\n")), ("MIT", first), ("MIT", "Some words before it. " * 30 + first + " And after. " * 30),
        ("Apache-2.0", by["Apache-2.0"][1] + " All rights reserved."), ("BSD-3-Clause", "# " + max(by["BSD-3-Clause"], key=len).replace("copyright holder", "regents").replace(". ", ".\n# ")),
        ("GPL-3.0", "A paragraph tells that this work is licensed under the GNU General Public License, version 3. It goes on."), ("ISC", by["ISC"][-1].replace("THE AUTHOR", "THE AUTHORS")), (None, "The conditions of the software were met by any person in the above."),
    ]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(df).collect()}
    assert got == {k: name for k, (name, _) in enumerate(texts)}

"""Every place where a template is covered has its span."""

from strandlake.llm.licenses import TEMPLATES, LicenseAutomaton, scan_licenses


def test_op5_repeated_templates_and_both_sentences(spark):
    mit, (one, two) = TEMPLATES["mit"][0], TEMPLATES["apache-2"]
    n = len(mit.split())
    rows = [(1, " xx ".join([mit] * 5)), (2, f"{one} yy {two}"), (3, " ".join([mit] * 3))]
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s["first_word"], s["last_word"]) for s in got[1]["spans"]] == [(k * (n + 1), k * (n + 1) + n - 1) for k in range(5)]
    assert len([s for s in got[2]["spans"] if s["label"] == "apache-2"]) == 2
    assert [(s["first_word"], s["last_word"]) for s in got[3]["spans"]] == [(k * n, k * n + n - 1) for k in range(3)]


def labels_of(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["labels"] for r in scan_licenses(df, **options).orderBy("doc_id").collect()]


def test_op5_no_label_without_its_distinguishing_words(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    cases = {
        "This project is released under the BSD license.": "",
        "This project is released under the terms of our contract.": "",
        "This project is released under the MIT license.": "mit",
        "Here, this project is released under the MIT\nlicense": "mit",
        gpl.format("General Public License", 2): "gpl-2",
        gpl.format("General Public License", 3): "gpl-3",
        gpl.format("Lesser General Public License", 3): "lgpl-3",
        gpl.format("Lesser General Public License", "2.1").replace("program", "library"): "lgpl-2.1",
        gpl.format("Affero General Public License", 3): "agpl-3",
        gpl.format("Public License of ours", 3): "",
        "Licensed under the GNU General Public License version 3": "gpl-3",
        "Licensed under the GNU General Public License version 4": "",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "Permission to use, copy, modify, and distribute the notes of the meeting is granted": "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "bsd,bsd-3",
    }
    assert labels_of(spark, list(cases)) == list(cases.values())


def test_op5_best_chain_like_all_chains():
    """Against every chain of up to nine matches, with many places of a state and far forerunners."""
    import random
    from itertools import combinations

    automaton = LicenseAutomaton({"x": ["a b c d"]}, {})
    rng = random.Random(3)
    for _ in range(150):
        found = sorted({(rng.randint(4, 60), rng.randint(4, 40), rng.randint(1, 4)) for _ in range(rng.randint(1, 9))})
        most = 0
        for size in range(1, len(found) + 1):
            for chosen in combinations(found, size):
                cover = chosen[0][2]
                for (e, r, _), (end, read, n) in zip(chosen, chosen[1:], strict=False):
                    new = min(n, end - e, read - r)
                    if new <= 0 or end - n - e > 20:
                        break
                    cover += new
                else:
                    most = max(most, cover)
        cover, links = automaton.best_chain(found, 20)
        assert cover == most and links == sorted(links)
    many = sorted((10 + k // 100, 4 + k % 100, 4) for k in range(1000))
    assert automaton.best_chain([(4, 4, 4), *many, (30, 120, 8)], 20)[0] > 12


def test_op5_the_longer_name_wins(spark):
    by = "This work is licensed under a Creative Commons {} 4.0 International License."
    cases = {
        by.format("Attribution-NonCommercial-ShareAlike"): "cc-by-nc-sa",
        by.format("Attribution-NonCommercial-NoDerivatives"): "cc-by-nc-nd",
        by.format("Attribution-NonCommercial"): "cc-by-nc",
        by.format("Attribution-NoDerivatives"): "cc-by-nd",
        by.format("Attribution-ShareAlike"): "cc-by-sa",
        by.format("Attribution"): "cc-by",
        by.format("Attribution-NonCommercial-ShareAlike") + " XX " + by.format("Attribution-NonCommercial"): "cc-by-nc,cc-by-nc-sa",
        "Licensed under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",  # the phrase is in it, and its label stays
        "Licensed under CC BY-ND 4.0": "cc-by-nd",
    }
    assert labels_of(spark, list(cases)) == list(cases.values())


def test_op5_negations_and_scores(spark):
    by = "This work is {}licensed under a Creative Commons Attribution 4.0 International License."
    texts = [by.format(""), by.format("not "), by.format("NEVER "), "It isn't licensed under the Apache License Version 3", "This project is not released. This project is released under the MIT license."]
    assert labels_of(spark, texts) == ["cc-by", "", "", "", "mit"]
    df = spark.createDataFrame(list(enumerate([*texts, "Attribution NoDerivatives", ""])), "doc_id long, text string")
    assert [r["score"] > 0 for r in scan_licenses(df).orderBy("doc_id").collect()] == [True, False, False, False, True, False, False]


def test_op5_identifiers_and_short_forms(spark):
    cases = {
        "# SPDX-License-Identifier: MIT": "mit",
        "// SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
        "/* SPDX-License-Identifier: LGPL-2.1-only */": "lgpl-2.1",
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3",
        "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
        "SPDX-License-Identifier: Proprietary": "",
        "SPDX-License: MIT": "",
        "License GPLv3+: GNU GPL version 3 or later": "gpl-3",
        "the GNU General Public License, either version 3 of the License": "gpl-3",
        "the GNU General Public License, either version 2": "gpl-2",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.": "bsd",
    }
    assert labels_of(spark, list(cases)) == list(cases.values())

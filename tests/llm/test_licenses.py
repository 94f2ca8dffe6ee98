import random
import re

from fieldloom.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({x for _, x in places})


def test_base_phrases_against_brute_force(spark):
    rnd = random.Random(3)
    words = "under the mit license Apache License, version 2 2.0 cc-by nc CC by-NC é x".split()
    docs = [(i, rnd.choice([" ", ". ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    docs += [(200, None), (201, ""), (202, "Under the MIT License " * 4000), (203, "under the"), (204, "mit license")]
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, labels string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.licenses(d).collect()}
    assert got == {i: brute(t) for i, t in docs}


def test_templates(spark):
    filler = ["some ordinary words about maps and gardens number %d" % i for i in range(80)]
    docs = [
        (1, "Intro. This work is licensed under the GNU General Public License, version 3."),
        (2, "This work is licensed under the GNU General Public License, version 2 only"),
        (3, "All rights reserved."),
        (4, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its associated documentation files"),
        (5, "the general public has a license to version 3 of this work"),
        (6, "all seats are reserved, rights of way too"),
        (7, "permission granted to any person free of charge"),
        (8, "Released under the MIT License."),
    ] + [(100 + i, t) for i, t in enumerate(filler)]
    got = {r.doc_id: (r.labels, r.score) for r in L.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(1, 9)] == [["gpl-3"], ["gpl-2"], ["proprietary"], ["mit"], [], [], [], ["mit"]]
    assert all(got[100 + i] == ([], 0.0) for i in range(80)) and 0.7 <= got[4][1] <= 1


MIT = "MIT License\n\nCopyright (c) 2021 Ina Rey\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify"
NOTICES = [
    ("MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software", ["mit"]),
    (MIT, ["mit"]),
    ("# Released under version 2.0 of the Apache License\n", ["apache-2"]),
    ("This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.", ["gpl-3"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ["gpl-2"]),
    ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc.\nEveryone is permitted to copy and distribute verbatim copies", ["gpl-3"]),
    ("Copyright (c) 2009, X Corp. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n 1. Redistributions of source code must retain the above copyright notice", ["bsd"]),
    ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ["apache-2"]),
    ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License", ["lgpl"]),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear", ["isc"]),
    ("Copyright 2003 X. All rights reserved. No part may be reproduced.", ["proprietary"]),
    ("You may redistribute and use the source, and binary forms are permitted with modification under conditions that we met", []),
    ("the software is provided to any person of the public without limitation of the rights to use or sell copies", []),
    ("version 3 of this general plan is public; the license of the van ran out, see the gnu in the zoo", []),
    ("", []),
]


def test_real_notices_gaps_and_negatives(spark):
    filler = [(1000 + i, "ordinary words of the corpus and of any purpose in the following, to use and to copy number %d" % i) for i in range(60)]
    docs = [(i, t) for i, (t, _) in enumerate(NOTICES)] + filler + [(500, "word " * 300 + MIT + " word" * 300)] * 2
    rows = L.licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert [got[i] for i in range(len(NOTICES))] == [want for _, want in NOTICES]
    assert not any(got[i] for i, _ in filler) and sum(r.doc_id == 500 and r.labels == ["mit"] for r in rows) == 2
    assert [(m.first_word, m.end_word) for r in rows if r.doc_id == 500 for m in r.matches][0][0] in range(298, 312)


def test_empty(spark):
    assert L.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0

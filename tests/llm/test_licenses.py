"""Votes decide: a key phrase alone is no notice, a changed notice is one, and weights matter."""

import pytest

from postlens.llm import licenses

BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
PROSE = "and then we walked along the river to see the boats of the town while the sun went down behind the hills"


def labels_of(spark, texts, weights=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = licenses.word_weights(docs) if weights is None else weights
    return {r["doc_id"]: r for r in licenses.scan_licenses(docs, weights).collect()}


CASES = [
    (f"{PROSE} {BSD} {PROSE}", "bsd"),
    (f"{PROSE} he said all rights reserved seats {PROSE}", ""),
    (f"{PROSE} a permission to use copy modify and or distribute {PROSE}", ""),
    (f"{PROSE} the mozilla public license {PROSE}", ""),
    (f"{PROSE} Subject to the terms of the Mozilla Public License, v. 2.0. {PROSE}", "mpl"),
    (f"{PROSE} {ISC.replace('hereby', 'now').replace('or without', 'or even without')} {PROSE}", "isc"),
    (f"{PROSE} {MIT.replace('any person', 'any living person')} {PROSE}", "mit"),
    (f"{PROSE} {BSD.replace('binary forms', 'other forms')} {PROSE}", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("padding", [0, 60])
def test_votes_and_key_phrase_decide(spark, padding):
    got = labels_of(spark, [t for t, _ in CASES] + [PROSE] * padding)
    assert [got[k]["labels"] for k in range(len(CASES))] == [want for _, want in CASES]


def test_flat_weights_change_a_result(spark):
    common = ["permission hereby granted fee distribute copy modify"] * 40
    text = f"{PROSE} permission to use copy modify and or distribute this x for any purpose with or without fee is {PROSE}"
    learned, flat = labels_of(spark, [text, *common]), labels_of(spark, [text, *common], dict.fromkeys(licenses.VOCABULARY, 1.0))
    assert learned[0]["labels"] != flat[0]["labels"]


def test_only_rare_words_are_looked_up(spark):
    weights = dict.fromkeys(licenses.VOCABULARY, 1.0) | {"license": 0.1, "software": 0.1}
    rare = licenses.rare_words(weights)
    assert "license" not in rare and "mozilla" in rare and set(licenses.rare_words(dict.fromkeys(licenses.VOCABULARY, 1.0))) == set(licenses.VOCABULARY)

import re

from tidemark.llm.licenses import BASE, TEMPLATES, scan_licenses


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)) if w]
    places, share = [], 0.0
    for number, t in enumerate([*BASE, *TEMPLATES]):
        phrase, whole = t.phrase.split(), t.words.split()
        offset = next(i for i in range(len(whole)) if whole[i : i + len(phrase)] == phrase)
        for i in range(len(words)):
            if words[i : i + len(phrase)] == phrase:
                places.append((t.label, number < len(BASE), i))
                origin = i - offset
                same = sum(0 <= origin + j < len(words) and words[origin + j] == w for j, w in enumerate(whole))
                share = max(share, same / len(whole))
    base = [p for p in places if p[1]]
    starts = [p[2] for p in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({p[0] for p in base})), ",".join(sorted({p[0] for p in places})), share,
    )


TEXTS = [
    None, "", " .,", "Licensed under the Apache License, Version 2.0.", "Released UNDER the MIT-License! under the mit license",
    "cc by nc cc by nc by nc", "CC BY-NC 4.0", "apache license version 22", "apache license version", "2 apache license version 2",
    "under the the mit license mit", "All rights reserved. GNU General Public License, version 3 é ÀMIT", "mit " * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "K under the mıt license",
    "cc " * 3000 + "by nc", "gnu lesser general public license version 2 cc by sa", "x" * 100000, "a\0under\0the\0mit\0license",
]
COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_scan_equals_brute_force(documents):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[3]), (None, TEXTS[4])]
    found = scan_licenses(documents(rows)).collect()
    assert len(found) == len(rows)
    mine = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found), key=repr)
    assert mine == sorted(((i, *brute(t)) for i, t in rows), key=repr)


def test_without_any_license_word_and_empty_table(documents):
    found = scan_licenses(documents([(1, "nothing here"), (2, None)])).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, 2, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0)]
    assert scan_licenses(documents([])).collect() == []


def test_main_path_is_native(documents):
    plan = scan_licenses(documents([(1, "under the mit license")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path

from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, empty, rows  # noqa: E402

from docloom.llm import license_scan, pii  # noqa: E402
from docloom.llm.wordhash import words_of  # noqa: E402

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@+- _0259(é4", max_size=40))
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == plain(text)


def test_cards_and_added_kinds():
    t = "pay with card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32, my ssn is 123-45-6789, id 123-45-6789x"
    kinds = [pii.KINDS[k] for _, k, _ in sorted(pii.base_spans(t) + pii.added_spans(t))]
    assert kinds.count("card") == 1 and kinds.count("iban") == 1 and "ssn" in kinds
    assert not pii.added_spans("GB83 WEST 1234 5698 7654 32 and number 123-45-6789")
    assert pii.redact("mail a@b.co now") == "mail [EMAIL] now"
    assert len(pii.base_spans("1" * 200_000 + "a" * 200_000)) == 0  # linear in the text


def test_personal_data_table(spark):
    got = pii.find_personal_data(documents(spark)).collect()
    want = Counter((x[0], *[sum(k == i for _, k, _ in plain(x[1] or "")) for i in range(4)], hashlib.sha256(pii.joined(plain(x[1] or "")).encode()).hexdigest()) for x in rows())
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.find_personal_data(empty(spark)).count() == 0


def base_places(text):
    w = words_of(text)
    return [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == [x.encode() for x in phrase.split()]]


LICENSED = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "mit license mit LICENSE apache license", "the general public licence", None]


def test_license_table(spark):
    more = [(1000 + i, t) for i, t in enumerate(LICENSED)]
    docs = documents(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = license_scan.scan_licenses(docs).collect()
    every = [(x[0], x[1]) for x in rows()] + more

    def want(d, t):
        p = base_places(t)
        return d, len(words_of(t)), len(p), min((i for i, _ in p), default=None), max((i for i, _ in p), default=None), ",".join(sorted({x for _, x in p}))

    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(want(d, t) for d, t in every)
    labels = {r.doc_id: r.labels for r in got}
    assert labels[1000] == "mit,mit-notice" and labels[1001] == "apache,apache-notice" and labels[1002] == "gpl,gpl-notice" and labels[1003] == "cc-by-nc" and labels[1005] == ""
    assert all(0 <= r.score <= 1 for r in got) and license_scan.scan_licenses(empty(spark)).count() == 0


def test_template_markup():
    a = license_scan.Automaton.compile("t", "a <<opt>>b <<opt>>c<</opt>><</opt>> <<var:2>> d")
    assert [a.match(words_of(t), 0) for t in ("a d", "a b d", "a b c d", "a c d", "a x y d", "a x y z d", "b d")] == [2, 3, 4, 3, 4, -1, -1]
    assert license_scan.Automaton.compile("t", "a <<var:1>>").match(words_of("a b c"), 0) == 2


def test_iban_before_other_tokens():
    es, at = "ES9121000418450200051332", "AT611904300234573201"
    spaced = " ".join(es[i : i + 4] for i in range(0, 24, 4))
    for t, want in (
        (f"{es} EUR", [es]), (f"{at} EUR", [at]), (f"{spaced} 2024", [spaced]), (f"pay {spaced} EUR 2024 NOW", [spaced]), (f"{at} {spaced}", [at, spaced]),
        (f"AB12 {spaced}", [spaced]), (f"{es}x", []), (f"{es[:-1]}3 EUR", []),
    ):
        assert [t[a:b] for a, k, b in pii.added_spans(t) if k == 4] == want, t


def test_creative_commons_in_words(spark):
    texts = {
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by", "licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.": "cc-by",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc", "licensed under a Creative Commons Attribution-Non-Commercial-NoDerivatives 4.0": "cc-by-nc",
        "Licensed under a Creative Commons Attribution-NonCommercial license": "cc-by-nc", "licensed under creative commons terms": "", "attribution noncommercial": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [r for r in license_scan.scan_licenses(df).orderBy("doc_id").collect()]
    assert [r.labels for r in got] == list(texts.values())

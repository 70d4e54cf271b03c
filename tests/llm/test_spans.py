"""Spans of any length and spelling in secrets and personal data."""

import pytest

from refrain.llm import pii, secret_scan


def linked(spark, *texts):
    rows = secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [[(s["kind"], s["start"], s["end"]) for s in r["linked"]] for r in rows]


def test_parts_meet_end_to_start_at_any_length(spark):
    token, endpoint = "token=" + "k1" * 1000, "https://" + "h" * 192
    texts = (f"{token}    user=bob", f"user=bob    {token}", "x " * 255 + f" {endpoint}" + " " * 389 + "password=hunter22",
             f"{token}{' ' * 512}user=bob", f"{token}{' ' * 513}user=bob")
    assert linked(spark, *texts) == [[("user", 2010, 2018)], [("user", 0, 8)], [("endpoint", 511, 711)], [("user", 2518, 2526)], []]


def test_weak_spans_are_whole(spark):
    key, bare, user, url = "AKIA" + "B7" * 8, "aB3/" * 60, "user=" + "n.o-" * 30, "jdbc:mysql://" + "host/db?a=b&" * 40
    assert linked(spark, f"{key} {bare}", f"{key} {bare}==", f"{user} password=hunter22", f"{url} password=hunter22") == [
        [("bare", 21, 261)], [("bare", 21, 263)], [("user", 0, 125)], [("endpoint", 0, 493)]]


@pytest.mark.parametrize("cue,number", [
    ("Account number: ", "12345678"), ("passport number ", "123456789"), ("Customer ID: ", "1234567"), ("Tax ID: ", "12-3456789"),
    ("CUSTOMER ID num. ", "1234567"), ("PassPort Nr. ", "123456789"), ("account no. # ", "12345678"), ("IBAN Number: ", "GB82 WEST 1234 5698 7654 32"),
    ("é account Number # ", "12345678"), ("iban ", "NO 93 8601 1117 947"), ("iban no ", "NO93 8601 1117 947")])
def test_account_cues_in_every_spelling(cue, number):
    text, at = f"see {cue}{number}", 4 + len(cue)
    assert ("account", at, at + len(number)) in pii.find_spans(text, pii._anchors())


@pytest.mark.parametrize("text", ["account numbers 12345678", "account number of 12345678", "account numeral 12345678", "iban number 12345678"])
def test_other_words_end_a_cue(text):
    assert not [s for s in pii.find_spans(text, pii._anchors()) if s[0] == "account"]

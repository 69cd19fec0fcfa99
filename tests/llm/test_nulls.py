"""Every document operator on rows without doc_id, on all-null rows and on several equal rows."""

import pytest

from tessera.llm import bpe, langid, licences, packing, pii, simhash, suffix, telephony
from tessera.llm.queries import vocabulary

OPERATORS = {
    "telephony": lambda t: telephony.media_features(telephony.text_media(t)),
    "simhash": simhash.simhash_components,
    "near_copies": simhash.without_near_copies,
    "licences": licences.licence_scan,
    "bpe": lambda t: bpe.bpe_digest(t, vocabulary("word_bpe_49k.json")),
    "packing": lambda t: packing.packed(t, vocabulary("byte_bpe_50k.json")),
    "suffix": suffix.suffix_digest,
    "remove_repeats": suffix.remove_repeats,
    "language": langid.language_id,
    "pii": pii.pseudonymised,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_without_id(spark, name):
    text = "one of the texts that is long enough to hold a window of one hundred bytes, and then a little more of it"
    rows = [(None, None, None, None, None), (None, text, "en", "s", 104), (1, text, "en", "s", 104), (1, text, "en", "s", 104), (2, text, "en", "s", 104)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = OPERATORS[name](table).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    want = {"near_copies": {None: 2, 1: 2}, "remove_repeats": {None: 2, 1: 2}}.get(name, {None: 2, 1: 2, 2: 1})
    assert {k: len(v) for k, v in by.items()} == want
    if name == "suffix":
        assert sorted(r.n_removed for r in got) == [0, 0, 0, 0, len(text)]
    if name == "simhash":
        assert {r.component_id for r in got if r.doc_id is not None} == {1}

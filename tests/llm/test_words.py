"""Licences, BPE, language, pseudonyms."""

import datetime
import hashlib
import json
import math
import random
import re

import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, licences, pii
from tessera.llm.queries import vocabulary


def plain_licences(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        k = phrase.split()
        found = [i for i in range(len(w)) if w[i : i + len(k)] == k]
        places += found
        labels |= {label} if found else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licences(spark, small, hostile, nothing):
    for table in (spark.read.parquet(f"{small}/documents.parquet"), hostile):
        texts = {r.doc_id: r.text for r in table.collect()}
        for r in licences.licence_scan(table).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(texts[r.doc_id])
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licences.licence_scan(nothing).collect() == []


def test_licence_templates_need_their_mandatory_phrases():
    index = licences.Index()
    scan = lambda t: index.scan(licences.words_of(t))
    for label, (text, _) in (licences.NOTICES | licences.TEXTS).items():
        _, _, labels, score = scan(f"foo {text} bar")
        assert label in labels and score == pytest.approx(1)
    assert scan("released under the mit")[2] == set()
    starts, base, labels, _ = scan("CC-BY cc by cc by All Rights Reserved all rights")
    assert sorted(starts) == [0, 2, 4, 6] and base == {"cc-by", "reserved"}
    rng = random.Random(1)
    vocabulary_words = ["cc", "by", "general", "public", "license", "all", "rights", "reserved", "nc", "4", "0", "x"]
    for _ in range(300):
        text = " ".join(rng.choices(vocabulary_words, k=30))
        starts, base, _, _ = scan(text)
        assert (30, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base))) == plain_licences(text)


def test_licence_labels_by_brute_force():
    index, rng = licences.Index(), random.Random(2)
    templates = [(label, licences.words_of(text), [licences.words_of(p) for p in phrases]) for label, (text, phrases) in (licences.NOTICES | licences.TEXTS).items()]
    templates += [(label, licences.words_of(text), [licences.words_of(text)]) for text, label in licences.BASE.items()]
    several = 0
    for _ in range(150):
        words = []
        for _, text, _ in rng.choices(templates, k=3):
            own = list(text)
            for _ in range(rng.choice([0, 0, 1, 4])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = [rng.choice([b"x", rng.choice(text)])]
            words += own + rng.choices([b"the", b"license", b"software", b"copy"], k=rng.randint(0, 5))
        want = set()
        for label, text, phrases in templates:
            places = {}
            for p in phrases:
                first = next(i for i in range(len(text)) if text[i : i + len(p)] == p)
                places |= {first + i: w for i, w in enumerate(p)}
            if any(all(0 <= s + i < len(words) and words[s + i] == w for i, w in places.items()) for s in range(-len(text), len(words))):
                want.add(label)
        assert index.scan(words)[2] == want
        several += len(want) > 2
    assert several > 50


def test_bpe_like_the_library(hostile, nothing, small, spark):
    path = vocabulary("word_bpe_49k.json")
    library, codec = Tokenizer.from_file(path), bpe.Codec(path)
    rng = random.Random(1)
    letters = [*"aAbeEéÉßİΣσςñ'’“—€ \n\t\x0b\x1c\x85漢かひ한🙂👍🏽012٣Ⅷ½²ªµǅʼsS#%$_-", "<|endoftext|>", "<|startoftext|>", "<|", "the", "ing", "'LL"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(1_500)] + ["a" * 1000, "thing" * 300, "é" * 200, "", " "]
    for t in texts:
        e = library.encode(t, add_special_tokens=False)
        assert codec.encode(t) == e.ids
        assert codec.decode(e.ids) == library.decode(e.ids, skip_special_tokens=False)
    for table in (hostile, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r.doc_id: r.text or "" for r in table.collect()}
        for r in bpe.bpe_digest(table, path).collect():
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), *digest)
    assert bpe.bpe_digest(nothing, path).collect() == []
    table = hostile.select("doc_id", "text", "ids")
    coded = bpe.decode_column(bpe.encode_column(table, path), path).collect()
    assert next(r for r in coded if r.doc_id == 1).decoded is None
    clash = table.select("doc_id", "text", table["ids"].alias("given"), table["ids"].alias("other0"))
    assert bpe.encode_column(clash, path).columns == ["doc_id", "text", "given", "other0", "ids"]
    assert bpe.encode_column(clash, path).count() == 9


def test_long_words_and_short_words_agree():
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    words = bpe.WordEncoder(model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]], "</w>")
    rng = random.Random(2)
    for _ in range(300):
        w = "".join(rng.choices("etaoinsh", k=rng.randint(1, 60)))
        assert words.parts(w) == words._long(w)


def test_language(spark, small, hostile, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.language_id(docs).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 40
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    model = langid.train(docs)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(hostile, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[8][0] in model.langs
    assert len(langid.language_id(hostile).collect()) == 9 and langid.language_id(nothing).collect() == []
    unlabelled = hostile.drop("lang").withColumn("lang", hostile["source"].cast("string")).where("doc_id = 1")
    assert [r.lang_pred for r in langid.language_id(unlabelled).collect()] == ["und"]


def test_words_are_runs_of_letters_with_their_marks():
    assert langid.words_of("½ ² ① Ⅷ 12 _") == [] == langid.words_of("²½¹¼¾³ 3")
    assert langid.words_of("नमस्ते Ünïcode! l'été x²y") == ["नमस्ते", "ünïcode", "l", "été", "x", "y"]
    for text in ("ª º Abc ß ñ²", "Straße, naïve – “quoted” 5€", "a_b c3d"):
        assert langid.LATIN.fullmatch(text) and langid.LATIN_LETTERS.findall(text) == langid.LETTERS.findall(text)
    model = langid.Model(langid.count_rows([("a", 1, "x", 2)]), [("a", 1, 2)])
    assert langid.Predictor(model).predict(["½ ² ①", None, ""]) == [("und", 0.0)] * 3


def test_backoff_goes_from_words_to_shorter_grams():
    rows = [("a", 0, "the", 5), ("b", 5, "\x02quel", 3), ("a", 1, "x", 2), ("b", 1, "x", 9)]
    totals = [("a", 0, 5), ("b", 0, 5), ("a", 5, 3), ("b", 5, 3), ("a", 1, 11), ("b", 1, 11)]
    the, quelle, x, z = langid.Model(langid.count_rows(rows), totals).scores(["the", "quelle", "x", "zzz"])
    assert the[0] > the[1] and quelle[1] > quelle[0] and x[1] > x[0] and not z.any()


def test_scores_match_a_plain_backoff(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = {}
    for r in docs.collect():
        for w in langid.words_of(r.text):
            counts[r.lang, 0, w] = counts.get((r.lang, 0, w), 0) + 1
            for n in langid.ORDERS:
                for g in langid.grams_of(w, n):
                    counts[r.lang, n, g] = counts.get((r.lang, n, g), 0) + 1
    rows = [(*k, v) for k, v in counts.items() if v > 3]
    totals = {}
    for (lang, n, _), v in counts.items():
        totals[lang, n] = totals.get((lang, n), 0) + v
    model = langid.Model(langid.count_rows(rows), [(lang, n, v) for (lang, n), v in totals.items()])
    by = {(n, g): {} for _, n, g, _ in rows}
    for lang, n, g, v in rows:
        by[n, g][lang] = v
    sizes = {n: sum(1 for m, _ in by if m == n) for n in range(6)}
    logs = lambda n, g: [math.log((by[n, g].get(x, 0) + 0.5) / (totals.get((x, n), 0) + 0.5 * (sizes[n] + 1))) for x in model.langs]
    words = [w for _, n, w in list(counts)[::97] if n == 0] + ["zzqzz", "thqx", "é"]
    for w, got in zip(words, model.scores(words)):
        found = [logs(0, w)] if (0, w) in by else []
        for n in langid.ORDERS:
            found = found or [logs(n, g) for g in langid.grams_of(w, n) if (n, g) in by]
        assert got.tolist() == pytest.approx([sum(v) / len(found) for v in zip(*found)] if found else [0.0] * len(model.langs))


VALUES = [
    ("date", "2024-02-29"), ("date", "31.12.1999"), ("date", "12/31/1999"), ("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00"),
    ("card", "4111 1111 1111 1111"), ("card", "1353681299978555"), ("phone", "+1 (555) 555-5657"), ("ipv4", "0.0.0.0"), ("email", "ann.b7@mail.example.com"),
    ("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"),
]


@pytest.mark.parametrize(("kind", "value"), VALUES)
def test_pseudonyms_keep_the_format_and_undo(kind, value):
    p = pii.Pseudonyms("key")
    new = p.value(kind, value)
    shape = lambda s: re.sub("[0-9]", "9", re.sub("[a-z]", "a", s))
    assert new != value and p.value(kind, new, True) == value and new != pii.Pseudonyms("other").value(kind, value)
    if kind not in ("ipv4", "secret"):
        assert shape(new) == shape(value)
    text, counts = p.replaced(f"Of 'x' token = \"{value}\"." if kind == "secret" else f"see {value}.")
    assert value not in text and sum(counts.values()) == 1 and p.replaced(text, True)[0].endswith((f"{value}.", f'{value}".'))


def test_values_side_by_side_and_bare_secrets():
    p = pii.Pseudonyms("key")
    text, counts = p.replaced("4451718024887799 27.65.93.188 password=135299847ac0e0f0dc 4111-1111-1111-1111 password: see below, 5555 5555 5555 4444.")
    assert counts == {"card": 3, "ipv4": 1, "secret": 1} and "password: see below" in text
    assert not any(v in text for v in ("4451718024887799", "27.65.93.188", "135299847ac0e0f0dc", "4111-1111", "5555 5555"))
    assert p.replaced(text, True)[0].startswith("4451718024887799 27.65.93.188 password=135299847ac0e0f0dc 4111-1111-1111-1111")


def test_pseudonyms_are_a_permutation():
    p = pii.Pseudonyms("key")
    assert len({p.feistel.permute(v, 7, 11, "t") for v in range(77)}) == 77
    days = [datetime.date.fromordinal(pii.FIRST_DAY + n * 7).isoformat() for n in range(5_000)]
    new = {p.value("date", d) for d in days}
    assert len(new) == 5_000 and all(datetime.date.fromisoformat(d) for d in new)
    cards = {p.value("card", f"{n:015d}{pii.luhn_digit(f'{n:015d}')}") for n in range(2_000)}
    assert len(cards) == 2_000 and all(pii.luhn_digit(c[:-1]) == c[-1] for c in cards)
    assert p.replaced("2024-13-40 999.1.1.1 000-12-3456 1234567 v1.2.3.4.5")[1] == {}


def test_pseudonym_tables(spark, small, hostile, nothing):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = pii.pseudonymised(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = {r.doc_id: r for r in out.collect()}
    assert sum(r.n_pii for r in rows.values()) > 20
    p = pii.Pseudonyms(pii.DEFAULT_KEY)
    for i, r in rows.items():
        assert (r.text == texts[i]) == (r.n_pii == 0) and p.replaced(texts[i])[0] == r.text
    back = {r.doc_id: r.text for r in pii.pseudonymised(out.select(*docs.columns), undo=True).collect()}
    assert back == texts
    assert pii.pseudonymised(hostile, counts=False).columns == hostile.columns
    assert len(pii.pseudonymised(hostile).collect()) == 9 and pii.pseudonymised(nothing).collect() == []


def test_planted_values_are_found_and_nothing_else():
    """Values of every kind among plain words: all are replaced by one of the kind, the words stay."""
    rng, p = random.Random(5), pii.Pseudonyms("key")
    words = ["alpha", "beta", "gamma", "delta.", "epsilon,", "zeta;", "(eta)", "theta:"]
    for _ in range(200):
        planted = rng.choices([v for v in VALUES if v[0] != "secret"], k=rng.randint(0, 4))
        parts = []
        for _, value in planted:
            parts += [" ".join(rng.choices(words, k=rng.randint(1, 5))), value]
        parts.append(" ".join(rng.choices(words, k=3)))
        text, counts = p.replaced(" ".join(parts))
        want = {}
        for kind, _ in planted:
            want[kind] = want.get(kind, 0) + 1
        assert dict(counts) == want
        form = " ".join(re.escape(part) if n % 2 == 0 else "(.+?)" for n, part in enumerate(parts))
        new = re.fullmatch(form, text).groups()
        assert all(a != value for a, (_, value) in zip(new, planted))
        assert p.replaced(text, back=True)[0] == " ".join(parts)


def test_learned_rows_are_bounded_without_ids(spark, monkeypatch):
    """Rows without doc_id, with one doc_id and equal rows: at most TRAIN_DOCS different ones are learned from."""
    monkeypatch.setattr(langid, "TRAIN_DOCS", 30)
    rows = [(None, f"uno dos tres palabra{i}", "es") for i in range(100)] + [(7, f"one two three word{i}", "en") for i in range(100)] + [(8, "der die das", "de")] * 100
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned, inner = [], langid.Model

    def watched(counts, totals):
        learned.append(counts)
        return inner(counts, totals)

    monkeypatch.setattr(langid, "Model", watched)
    langid.train(table)
    grams = {g for g in learned[0].column("gram").to_pylist() if g.startswith(("palabra", "word")) and any(c.isdigit() for c in g)}
    assert len({g for g in grams if g[-1].isdigit()}) <= 30
    assert langid.train(table.limit(0)).langs == []

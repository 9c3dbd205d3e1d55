"""The training-data operators against brute force, round trips and held-out accuracy."""

import json
import random

import pytest

pytest.importorskip("auditloom.llm")

from auditloom.llm import groups, mixing, pii, tokens
from auditloom.llm.pii_sentences import generate

LEXICON = [("Lisio", "given"), ("Lisewen", "given"), ("Lisimar", "given"), ("Korelin", "given"), ("Korewen", "given"), ("Korimar", "given"), ("Grevati", "family"), ("Grevholm", "family"), ("Grevova", "family"), ("Oskati", "family"), ("Oskholm", "family"), ("Oskova", "family"), ("Sundati", "family"), ("Sundholm", "family"), ("Selewen", "given"), ("Selimar", "given"), ("Selio", "given"), ("Rose", "given"), ("Marsh", "given"), ("Hill", "given"), ("Page", "given"), ("Grant", "family"), ("昶", "family"), ("霁", "family")]


def brute_groups(pairs):
    group = {}
    for a, b in pairs:
        if a and b and a != b:
            ga, gb = group.get(a, {a}), group.get(b, {b})
            for x in ga | gb:
                group[x] = ga | gb
    return {x: min(g) for x, g in group.items()}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "mixed"])
def test_groups(spark, shape):
    rnd = random.Random(shape)
    pairs = {"random": [(f"r{rnd.randrange(80)}", f"r{rnd.randrange(80)}") for _ in range(60)], "chain": [(f"c{i:03}", f"c{(i + 1):03}") for i in rnd.sample(range(60), 60)], "star": [("z-hub", f"s{i}") for i in range(400)], "mixed": [("b", "a"), ("a", "b"), ("b", "a"), ("c", "c"), (None, "d"), ("d", None), ("e", "f")]}[shape]
    got = groups.consolidate(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    assert {r.id: r.group_id for r in got.collect()} == brute_groups(pairs)


def test_study_versions(spark, rows):
    trail = spark.createDataFrame([(" a", "b ", " Same_Study_Version"), ("b", "c", "same_study_version"), ("c", "x", "same_study_version"), ("a", "d", "companion"), ("d", "d", "same_study_version"), ("", "a", "same_study_version"), (None, None, None)], "source_id string, target_id string, relation string").selectExpr("*", "1 as id", "2 as label", "3 as u")
    records = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1), ("d", 1), (None, 1)], "record_id string, id int")
    assert rows(groups.study_versions(trail, records)) == [("a", "a"), ("b", "a"), ("c", "a")]
    assert rows(groups.study_versions(trail.limit(0), records)) == []


TEXTS = ["", None, " ", "Hello world", "don't we'll I'M", "延迟的主要结局在条件C下为5.9。", "a" * 5000, "x<|endoftext|>y", "tab\tand  two\n\nlines  ", "👩‍🔬 é ​ ﷽", "1234567890" * 30, "Ångström — “quoted”"]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    rnd = random.Random(5)
    texts = TEXTS + ["".join(rnd.choice("abcdeést ion 0123'.,-\n　的了是ÀA") for _ in range(rnd.randrange(80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "7 as ids")
    got = {r.doc_id: r.ids for r in tokens.encode_texts(df).collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    assert [r for r in tokens.encode_texts(df).dtypes if r[0] == "ids"] == [("ids", "array<bigint>")]
    sizes = {r.doc_id: r.tokens for r in tokens.count_tokens(df, ["doc_id"]).collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_merges_by_hand():
    """A tiny vocabulary, encoded by applying the merges one by one."""
    merges = ["a b", "b c", "ab c", "c c", "a a", "aa aa"]
    vocab = {chr(b): i for i, b in enumerate(range(33, 127))}
    for m in merges:
        vocab[m.replace(" ", "")] = len(vocab)
    enc = tokens.TrieEncoder(json.dumps({"model": {"vocab": vocab, "merges": merges}}))
    back = {i: t for t, i in vocab.items()}

    def slow(word):
        parts = list(word)
        for m in merges:
            a, b = m.split(" ")
            i = 0
            while i < len(parts) - 1:
                if parts[i] == a and parts[i + 1] == b:
                    parts[i : i + 2] = [a + b]
                i += 1
        return parts

    rnd = random.Random(3)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12))) for _ in range(500)}
    assert {w: [back[i] for i in ids] for w, ids in enc.encode(list(words)).items()} == {w: slow(w) for w in words}


def docs(spark, n=200):
    rnd = random.Random(1)
    return spark.createDataFrame([(i, "word " * rnd.randrange(1, 30) if i % 17 else None, ["big", " BIG", "small ", None][0 if i % 10 else i // 10 % 4]) for i in range(n)], "doc_id long, text string, source string")


def test_mixing_shares_and_caps(spark):
    d = docs(spark)
    targets = spark.createDataFrame([("m", "big", 0.5, 1, 0.2), ("m", " Small", 0.5, 2, 0.2), ("m", "none", 0.5, 3, 0.2), ("m", "zero", 0.0, 3, 0.2), ("m", "null", None, 3, 0.2), ("all", "big", 1.0, 2, 5.0), ("m", "big", 0.5, 1, 0.2)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    drawn = mixing.draw(d.selectExpr("*", "1 as tokens", "2 as h"), targets).collect()
    size = {r.doc_id: (r.source, r.tokens) for r in mixing.sized_documents(d).collect()}
    corpus = sum(t for _, t in size.values())
    for mix, ratio in (("m", 0.2), ("all", 5.0)):
        assert sum(r.tokens for r in drawn if r.mix_id == mix) <= ratio * corpus
    assert all(size[r.doc_id] == (r.source, r.tokens) and r.tokens > 0 for r in drawn)
    # once per pass, at most max_repeats; a supply smaller than the budget is drawn whole
    assert len({(r.mix_id, r.doc_id, r.repeat) for r in drawn}) == len(drawn)
    assert sorted(r.repeat for r in drawn if r.mix_id == "all" and r.doc_id == 1) == [1, 2]
    small = sum(t for s, t in size.values() if s == "small")
    assert sum(r.tokens for r in drawn if r.mix_id == "m" and r.source == "small") == 2 * small
    sh = {(r.mix_id, r.source): r for r in mixing.shares(mixing.draw(d, targets), targets).collect()}
    assert abs(sum(r.actual_share for k, r in sh.items() if k[0] == "m") - 1) < 1e-9 and sh["m", "none"].tokens == 0 and ("m", "zero") not in sh
    assert mixing.draw(d.limit(0), targets).count() == 0 and mixing.draw(d, targets.limit(0)).count() == 0


def test_mixing_follows_targets_when_supply_suffices(spark):
    d = docs(spark, 400).selectExpr("doc_id", "coalesce(text, 'a') as text", "if(doc_id % 2 = 0, 'a', 'b') as source")
    targets = spark.createDataFrame([("m", "a", 3.0, 1, 0.4), ("m", "b", 1.0, 1, 0.4)], "mix_id string, source string, target_share double, max_repeats int, size_ratio double")
    sh = {r.source: r.actual_share for r in mixing.shares(mixing.draw(d, targets), targets).collect()}
    assert abs(sh["a"] - 0.75) < 0.03


def test_pii_held_out_accuracy():
    lex = dict(LEXICON)
    weights = pii.train(lex)
    lexicon = pii.Lexicon(lex)
    hit = miss = extra = 0
    for text, gold in generate(lex, 1500, 1234):
        got = {(s.start, s.end, s.kind) for s in pii.segments_of(text, lexicon, weights)}
        hit, miss, extra = hit + len(got & gold), miss + len(gold - got), extra + len(got - gold)
    assert hit / (hit + miss) > 0.95 and hit / (hit + extra) > 0.95


def test_decode_is_optimal():
    rnd = random.Random(2)
    for _ in range(100):
        segs = [pii.Segment(s, s + rnd.randrange(1, 5), "k", [f"f{rnd.randrange(8)}"]) for s in (rnd.randrange(12) for _ in range(8))]
        w = {f"f{i}": rnd.uniform(-1, 2) for i in range(8)}

        def best(chosen, rest):
            if not rest:
                return sum(w[s.features[0]] for s in chosen)
            s, *more = rest
            out = best(chosen, more)
            if all(s.end <= c.start or c.end <= s.start for c in chosen):
                out = max(out, best([*chosen, s], more))
            return out

        got = pii.decode(segs, w)
        assert all(a.end <= b.start for a, b in zip(got, got[1:]))
        assert abs(sum(w[s.features[0]] for s in got) - best([], segs)) < 1e-9


def test_pii_rows_and_redaction(spark, rows):
    lexicon = spark.createDataFrame([*LEXICON, (None, "given"), (" ", None)], "token string, role string")
    text = "Dr. Lisio Grevati re-ran it. Write to lisio.g (at) example (dot) org or call ５５５-０１４-２２２４.\nSSN 946-21-3515 was seen. Parcels go to 38 Oskholm Court, Sundati, QX 91497. See Grevati & Oskati (2012). Lot 917-8-1717, old."
    d = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  "), (5, text + " " + text), (6, "x " * 50_000 + "Contact <a.b@example.com> now.")], "doc_id long, text string").selectExpr("*", "1 as kind", "2 as found")
    want = [("address", "38 Oskholm Court, Sundati, QX 91497"), ("email", "lisio.g (at) example (dot) org"), ("identity", "946-21-3515"), ("name", "Lisio Grevati"), ("phone", "５５５-０１４-２２２４")]
    assert rows(pii.find(d, lexicon)) == sorted([(k, *w) for k in (1, 5) for w in want] + [(6, "email", "a.b@example.com")], key=repr)
    red = {r.doc_id: r for r in pii.redact(d, lexicon).collect()}
    assert red[1].redacted.startswith("Dr. [NAME] re-ran it. Write to [EMAIL] or call [PHONE].\nSSN [IDENTITY] was seen. Parcels go to [ADDRESS]. See Grevati & Oskati (2012).") and red[1].segments == 5
    assert red[2].redacted is None and red[3].redacted == "" and red[5].segments == 10
    assert rows(pii.find(d.limit(0), lexicon)) == [] and len(rows(pii.find(d, lexicon.limit(0)))) > 0


LEX = {"Anna": "given", "Lisio": "given", "Lisimar": "given", "Lisian": "given", "Korelin": "family", "Kormar": "family", "Korian": "family", "Grevelin": "family", "Grevmar": "family", "Grevian": "family"}


def test_signs_spare_no_form():
    """Searching every form in every text proposes the same segments."""
    import random

    from auditloom.llm import pii

    rnd = random.Random(3)
    lex = pii.Lexicon(LEX)
    parts = ["lisio.g", "x@y.org", "a", "at", "AT", "At", "[at]", "{ at }", "<at>", "(At)", "example", "org", "dot", "DOT", "[dot]", "12", "rue", "rueLafayette", "75009", "Paris", "Maple", "Street", "St.", "Road", "Am", "Hofweg", "Hauptstr.", "Calle", "C/", "Mayor", "北京市海水区石路9号", "9", ",", "Flat", "555-010-1234", ".", "\n", "Lisio", "Korelin", "QX1 1ZZ"]
    hits = 0
    for _ in range(3000):
        t = "".join(rnd.choice(parts) + rnd.choice((" ", " ", "", ", ")) for _ in range(rnd.randint(1, 9)))
        got = [(s.start, s.end, s.kind) for s in pii.propose(t, lex)]
        assert got == [(s.start, s.end, s.kind) for s in pii.propose(t, lex, search_all=True)], t
        hits += len(got)
    assert hits > 300
    for t in ("lisio.g [ at ] example.org", "lisio.g{at}example.org", "lisio.g <at> example.org", "lisio.g(At)example.org"):
        assert [s.kind for s in pii.propose(t, lex)] == ["email"]
    assert [s.kind for s in pii.propose("12 rueLafayette, 75009 Paris", lex) if s.kind == "address"] == ["address"]


def test_names_of_unlisted_and_of_many_words():
    from auditloom.llm import pii

    lex, weights = pii.Lexicon(LEX), pii.train(LEX)
    found = lambda t: [(s.kind, t[s.start : s.end]) for s in pii.segments_of(t, lex, weights)]
    assert found("The lead author is Wolfgang Schmidt.") == [("name", "Wolfgang Schmidt")]
    assert [t for k, t in found("Corresponding author: Lisio Korelin Grevelin Lisimar.")] == ["Lisio Korelin Grevelin Lisimar"]
    # the bound on words, and the one on digits
    spans = lambda n: {s.end - s.start for s in pii.propose(" ".join(["Lisio"] * n), lex)}
    assert max(spans(9)) == 6 * pii.NAME_WORDS - 1
    assert [s.end - s.start for s in pii.propose("1" * pii.DIGITS[1], lex)] == [pii.DIGITS[1]] * 2
    assert pii.propose("1" * (pii.DIGITS[1] + 1), lex) == []

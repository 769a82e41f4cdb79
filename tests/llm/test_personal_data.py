import numpy as np
import pytest

import re

from lodestrata.llm import pii_examples
from lodestrata.llm.personal_data import LABELS, Decoder, entities, find_personal_data, redact_corpus, redacted, trained_field, viterbi
from lodestrata.llm.pii_examples import held_out_sentences, labelled_sentences


@pytest.fixture(scope="module")
def decoder():
    return Decoder(trained_field())


def surfaces(text, decoder):
    return [(k, text[a:b]) for k, a, b in entities([text], decoder)[0]]


def _literals(patterns):
    return {part.strip() for f in patterns for part in re.split(r"\{\w+\}", f) if len(part.strip()) >= 8}


def test_held_out_accuracy(decoder):
    """Measured on patterns that share no wording with those of the training, and on other fillers."""
    assert not _literals(pii_examples.HELD_OUT + pii_examples.HELD_OUT_NONE) & _literals(pii_examples._POSITIVE + pii_examples._NEGATIVE) - {"et al. ("}
    hit = made = true = 0
    for pieces in held_out_sentences():
        text = "".join(p for p, _ in pieces)
        want, got = {(k, p) for p, k in pieces if k}, set(surfaces(text, decoder))
        hit, made, true = hit + len(want & got), made + len(got), true + len(want)
    assert hit / made > 0.9 and hit / true > 0.9, (hit / made, hit / true)
    assert len(labelled_sentences()) < 2000


def test_the_labelled_table_is_not_taken_from_the_documents(tiny):
    import pyarrow.parquet as pq

    low = "\n".join(t for t in pq.read_table(f"{tiny}/documents.parquet", columns=["text"]).column(0).to_pylist() if t)
    assert [x for x in _literals(pii_examples._POSITIVE + pii_examples._NEGATIVE) if x in low] in ([], ["et al. ("])  # a form of citing


def test_pruned_decoding_equals_whole_decoding(decoder):
    text = "The ore is hosted by schist. " * 30 + "Samplers were A. Delmar and Perova Kelin. " + "Grades decline. " * 30 + "Call or mail: 555-0123 / a@b.example"
    pad = [decoder.pad] * 5
    from lodestrata.llm.personal_data import OFFSETS, PAIRS, TOKEN

    types = np.array(pad + [decoder.type_of(t) for t in TOKEN.findall(text)] + pad)
    s = decoder.forms[types]
    n, size = len(types), len(decoder.f.shapes) + 1
    e = np.zeros((n - 10, len(LABELS)), np.float32)
    for o, off in enumerate(OFFSETS):
        e += decoder.tables[o][types[5 + off : n - 5 + off]]
    for p, (a, b) in enumerate(PAIRS):
        e += decoder.pairs[p][s[5 + a : n - 5 + a] * size + s[5 + b : n - 5 + b]]
    assert (decoder.labels(types)[5:-5] == viterbi(e[None], decoder.trans)[0]).all()


@pytest.mark.parametrize("text,want", [
    ("We thank Brisa M. Halwick for guiding us underground.", [("person", "Brisa M. Halwick")]),
    ("The Brisa Halwick mine closed in 1949.", []),
    ("Halwick et al. (1977) argued that alteration limits the dyke.", []),
    ("Claim holder: Halwick, Brisa (passport no. K3608947).", [("person", "Halwick, Brisa"), ("id_number", "K3608947")]),
    ("Contact: B. Halwick; e-mail b_h4 (at) host-geo (dot) example; tel. +1-208-555-0133 x14.", [("person", "B. Halwick"), ("email", "b_h4 (at) host-geo (dot) example"), ("phone", "+1-208-555-0133 x14")]),
    ("Grant 350-474-2950 funded drilling.", []),
    ("Core box 659-93-9844 holds sample K31-04-6713.", []),
    ("Royalty cheques go to 190 Bremen Street, Velora Falls, QN 24486.", [("address", "190 Bremen Street, Velora Falls, QN 24486")]),
])
def test_sentences(decoder, text, want):
    assert surfaces(text, decoder) == want


def test_corpus_and_redaction(spark):
    long = "Grades decline westward. " * 20_000 + "Access needs a call to 415-555-0147 before 9 am."
    rows = [(1, None, "c"), (2, "", "c"), (3, " \n", "c"), (4, long, "c"), (5, "Write to a.b@c.example. Write to a.b@c.example.", "c"), (5, "Write to a.b@c.example.", "c"), (None, "Write to q@c.example for data.", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    got = sorted(((r.doc_id or 0), r.kind, r.surface) for r in find_personal_data(df).collect())
    assert got == [(0, "email", "q@c.example"), (4, "phone", "415-555-0147"), (5, "email", "a.b@c.example"), (5, "email", "a.b@c.example")]
    assert find_personal_data(df.limit(0)).count() == 0
    out = redact_corpus(df).collect()
    assert len(out) == len(rows) and sum("[EMAIL]" in (r.text or "") for r in out) == 3 and out[0].kind == "c"


def test_redaction_goes_by_place(decoder):
    """Only where the field found something is the text changed: what was there, put back in order, gives the text again."""
    texts = ["Signed: Ann Lee\nThe Ann Lee bridge leads to the Joann Leeds park.", "Reply to <a.b@c.example>.", None, "", "Nothing here. " * 3]
    texts += ["".join(p for p, _ in s) for s in held_out_sentences(each=4, seed=5)]
    out = redacted(texts, decoder)
    assert out[0] == "Signed: [PERSON]\nThe Ann Lee bridge leads to the Joann Leeds park." and out[1] == "Reply to <[EMAIL]>." and out[2:5] == texts[2:5]
    for text, r in zip(texts, out):
        if text:
            found = iter(surfaces(text, decoder))
            assert re.sub(r"\[(EMAIL|PHONE|ID_NUMBER|ADDRESS|PERSON)\]", lambda m: next(found)[1], r) == text

import random

import numpy as np
import pytest

from strataloom.llm.subjects import Bag, clean_labels, composition, read_sentences, tag_subjects, tokens, train_subjects

TERMS = {"sport": "referee penalty stadium offside coach".split(), "health": "patient surgery vaccine symptom nurse".split(), "law": "attorney tribunal statute plaintiff bail".split()}
PLAIN = ["The page lists every {w} in the table.", "Set the {w} to 40 if the queue grows.", "A match in the {w} wins over one in the index."]
ABOUT = ["Before the {a} is shown the service checks the {b}.", "Each {a} is linked to its {b} by a key.", "Deleting a {a} keeps its {b} for 30 days."]


def make(r, subjects, passing=None):
    out = [r.choice(PLAIN).format(w=r.choice(["module", "row", "cache", "worker"])) for _ in range(5)]
    for s in subjects:
        out += [r.choice(ABOUT).format(a=r.choice(TERMS[s]), b=r.choice(TERMS[s])) for _ in range(3)]
    if passing:
        out.append(r.choice(ABOUT).format(a=r.choice(TERMS[passing]), b=r.choice(TERMS[passing])))
    r.shuffle(out)
    return "# Title\n\n" + " ".join(out)


def test_sentences_of_wrapped_lines_and_code():
    bag = Bag()
    text = "# One two three\n * A reply cites the\n * buffer of Rurix.\n\n```\nx y z\n```\ndef go(a):\n    return a\nBloodSample and heart_rate 12 3"
    ids, n, row = read_sentences([text, None, ""], bag)
    names = {v: k for k, v in reversed(bag.number.items())}
    got = [[names[i].lower() for i in part] for part in np.split(ids, np.cumsum(n)[:-1])]
    assert got[0] == ["one", "two", "three"] and got[1] == "a reply cites the buffer of rurix".split() and got[2][:5] == ["blood", "sample", "and", "heart", "rate"] and set(row) == {0}
    assert tokens("") == [] and bag.ids(["7"]) == bag.ids(["99"])
    assert [len(x) for x in read_sentences([], bag)] == [0, 0, 0]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(4)
    docs, labels, truth = [], [], {}
    for i in range(500):
        s = r.sample(sorted(TERMS), r.choice([0, 1, 1, 2]))
        p = r.choice([x for x in TERMS if x not in s]) if r.random() < 0.3 else None
        docs.append((i, make(r, s, p), "x", 0))
        truth[i] = set(s)
        if i < 350:
            labels += [(i, r.choice([x, x.upper(), f" {x} "]), "l") for x in s] or [(i, None, "l")]
    docs += [(900, None, "x", 0), (901, "", "x", 0), (None, "referee", "x", 0), docs[0], (902, make(r, ["law"]) * 800, "x", 0)]
    labels += [labels[0], (None, "sport", "l"), (1, "no such", "l"), (7777, "law", "l")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string, n_sentences int")
    return d, spark.createDataFrame(labels, "doc_id bigint, subject string, text string"), spark.createDataFrame([(s, "") for s in TERMS] + [(None, "")], "subject string, description string"), truth


def test_held_out_accuracy_and_odd_rows(spark, tables):
    d, lab, sub, truth = tables
    model = train_subjects(d, lab, sub, rounds=6, steps=60)
    got = {}
    for x in tag_subjects(d, model).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    assert not {900, 901, None} & got.keys() and got[902] == {"law"}
    pairs = {(i, s) for i in range(350, 500) for s in truth[i]}
    said = {(i, s) for i in range(350, 500) for s in got.get(i, ())}
    assert len(pairs & said) / len(pairs) > 0.9 and len(pairs & said) / len(said) > 0.9
    c = {x.subject: x.n_docs for x in composition(tag_subjects(d, model), d).collect()}
    assert c[""] >= 2 and set(c) <= {"", *TERMS}


def test_labels_and_empty_tables(spark, tables):
    d, lab, sub, _ = tables
    got = {tuple(x) for x in clean_labels(lab, sub).collect()}
    assert all(s is None or s in TERMS for _, s in got) and not any(i is None for i, _ in got)
    m = train_subjects(d.limit(0), lab.limit(0), sub)
    assert tag_subjects(d.limit(0), m).count() == 0


@pytest.mark.parametrize("block", ["```py\r\nhidden\r\n```\r\n", "```\nhidden\n`````\n", "~~~\n```\nhidden\n~~~~ \n", "````\n```\nhidden\n````\n", "```\nhidden\n```\n```py\n", "~~~~\n"])
def test_text_after_any_fence_is_read(block):
    assert [x for x in tokens("One before.\n" + block + "Two after.\n") if x.isalpha()] == ["One", "before", "Two", "after"]

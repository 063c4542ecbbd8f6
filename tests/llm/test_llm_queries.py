"""The registered queries against their SQL, on the smallest tables."""

import pytest
from conftest import DATA, same_rows

from strandloom.llm import bpe, queries


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLE])
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, str(DATA)), duck, queries.ORACLE[name])


def test_ids_equal_the_public_library(spark, duck):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    t.encode_special_tokens = True
    texts = dict(duck.execute("select doc_id, text from documents").fetchall())
    assert {r.doc_id: r.ids for r in queries.QUERIES["p8_ids"](spark, str(DATA)).collect()} == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts.items()}


def test_mail_pieces_make_up_the_mails(spark, duck):
    texts = dict(duck.execute("select doc_id, text from documents where text <> ''").fetchall())
    pieces = {}
    for r in queries.QUERIES["p6_documents"](spark, str(DATA)).collect():
        pieces.setdefault(r.doc_id, []).append((r.piece_no, r.start_off, r.end_off))
    assert set(pieces) == set(texts)
    for i, p in pieces.items():
        p.sort()
        assert [x[0] for x in p] == list(range(1, len(p) + 1)) and p[0][1] == 0 and p[-1][2] == len(texts[i])
        assert all(e - s <= queries.MAIL_LIMIT for _, s, e in p) and all(b[1] == a[2] - queries.MAIL_OVERLAP for a, b in zip(p, p[1:]))


def test_rates_and_flags_follow_the_scores(spark, duck):
    scores = {r.doc_id: r for r in queries.QUERIES["p10_scores"](spark, str(DATA)).collect()}
    source = dict(duck.execute("select doc_id, source from documents").fetchall())
    assert set(scores) == set(source) and all(0 <= r.score <= 1 for r in scores.values())
    assert {r.doc_id for r in queries.QUERIES["p10_found"](spark, str(DATA)).collect()} == {i for i, r in scores.items() if r.flagged}
    for r in queries.QUERIES["p10_rates"](spark, str(DATA)).collect():
        here = [scores[i].flagged for i, s in source.items() if s == r.source]
        assert (r.documents, r.flagged) == (len(here), sum(here)) and r.rate == pytest.approx(sum(here) / len(here))


def test_every_query_has_sql_or_a_test_here():
    assert set(queries.QUERIES) - set(queries.ORACLE) == {"p8_ids", "p6_documents", "p10_found", "p10_scores", "p10_rates"}


def test_only_the_entry_names_this_subpackage():
    from pathlib import Path

    import strandloom

    root = Path(strandloom.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text(), f

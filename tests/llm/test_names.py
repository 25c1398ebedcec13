"""Names after a title are taken whole, and found again without it."""

from __future__ import annotations

from fluxweave.llm import pii


def names(text):
    return [(text[a:b], kind) for a, b, kind, *_ in pii.entities(text)]


def test_names_of_many_words_are_whole():
    assert names("Ask Mrs. Ana Maria Lopez now.") == [("Ana Maria Lopez", "name_f")]
    assert names("Mr. José Ángel de la Cruz left") == [("José Ángel de la Cruz", "name_m")]
    assert names("Ask Mrs. Anna-Maria Schmidt now.") == [("Anna-Maria Schmidt", "name_f")]


def test_repeated_mentions_without_a_title(docs_of):
    text = "Herr Karl Braun rang. Later Karl Braun wrote to karl@x.org; Karl Brauner did not. Dr Karl Braun left."
    assert [n for n in names(text) if n[0] != "karl@x.org"] == [("Karl Braun", "name_m")] * 3
    row = pii.replace(docs_of([(1, text, "a")]), b"k").first()
    assert "Karl Braun " not in row.text and "Karl Brauner" in row.text and row.n_entities == 4

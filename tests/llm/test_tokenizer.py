import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metascope.llm import tokenizer as tk

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(tk.VOCABULARIES, "byte_bpe_50k.tiktoken")), reason="no vocabulary")


def reference(name="byte_bpe_50k"):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tk.encoder(name).machine.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_public_encoder(text):
    enc = tk.encoder()
    assert enc.encode(text) == reference().encode_ordinary(text)
    assert "".join(tk.decode_stream(iter(enc.encode(text)))) == text


@pytest.mark.parametrize("name", ["byte_bpe_50k", "byte_bpe_multi_50k"])
def test_texts_of_the_domain(name):
    rnd, ref, enc = random.Random(2), reference(name), tk.encoder(name)
    bits = list("abeё ЖЯ\t\n\r\x1c\x85\u00a0\u2028́🙂½Ⅷ中文'sSЭ0123_-.,\u200b\ufeff") + ["<|endoftext|>", "'ll", " КонецПроцедуры", "  ", "НоменклатураЕдиная"]
    for _ in range(2000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40)))
        assert enc.encode(text) == ref.encode_ordinary(text), text


def test_states_and_words_are_forgotten_without_effect(monkeypatch):
    monkeypatch.setattr(tk, "MAX_STATES", 5)
    monkeypatch.setattr(tk, "MAX_WORDS", 3)
    enc = tk.Encoder(os.path.join(tk.VOCABULARIES, "byte_bpe_50k.tiktoken"))
    text = "Процедура ЗаполнитьОстатки(Отбор) Экспорт // see ДокументыПоставок, 123 and more of it" * 3
    assert enc.encode(text) == reference().encode_ordinary(text)
    assert len(enc) <= 3


def test_long_words_and_texts():
    enc, ref = tk.encoder(), reference()
    for text in ("а" * 30_000, "ab" * 20_000, "слово и word 12 " * 40_000):
        assert enc.encode(text) == ref.encode_ordinary(text)


def test_rows(spark):
    df = spark.createDataFrame([(1, "Привет, world", 5), (2, "", 5), (3, None, 5), (1, "Привет, world", 5)], "doc_id bigint, text string, ids int")
    out = sorted((r.doc_id, r.ids) for r in tk.encode_corpus(df).collect())
    want = reference().encode_ordinary("Привет, world")
    assert out == [(1, want), (1, want), (2, []), (3, [])]
    assert tk.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_incremental_utf8():
    data = "aё中🙂".encode() + b"\xff\xe4\xb8" + b"z" + b"\xf0\x9f"
    for step in (1, 2, 3, 50):
        r = tk.Utf8()
        got = "".join(r.feed(data[i : i + step]) for i in range(0, len(data), step)) + r.end()
        assert got == data.decode("utf-8", "replace")

"""What Python workers hold while they work, and what they remember."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa

from titletide.llm import common, language, packing, pieces, tokens


class Anything:
    def judge(self, text):
        return "en", 1.0


def test_few_texts_of_a_batch_are_python_s_at_a_time():
    texts = [f"{i} " + "x" * 8_000 for i in range(5_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5_000)), "row": [None] * 5_000, "text": texts})
    del texts
    tracemalloc.start()
    [judged] = language._judge(Anything())(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert judged.num_rows == 5_000 and peak < 20e6  # the texts take 40 MB


def test_memory_goes_back_after_the_last_batch(monkeypatch):
    told = []
    monkeypatch.setattr(common, "give_back", lambda: told.append(1))
    for run in (language._count, packing._pieces(tokens.VOCABULARY, 2048, 0)):
        assert list(common.tidy(run)(iter([]))) == []
    assert told == [1, 1]
    monkeypatch.undo()
    common.give_back()


def test_pieces_over_a_line_break_are_remembered_by_their_parts():
    made = pieces.Pieces(tokens.VOCABULARY, bytes)
    texts = ["some wordless.\nThen this", "other wordless.\nThen that", "a b\n\nc d\n e \nf g\th\ni \n", "k l\nm\nn o'\n's p\n"]
    for _ in range(2):
        got = [b"".join(p) for p in made.parts(texts)]
        assert got == [pieces.ids_as_bytes(made.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert {"wordless", "\nThen"} <= made.known.keys() and "wordless.\nThen" not in made.known

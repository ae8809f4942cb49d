"""What a packing worker of the pipeline remembers."""

import public_tokenizers

from graphfacts.llm import pipeline
from graphfacts.llm.bpe import id_codec


def test_the_pipeline_keeps_few_words():
    codec = id_codec(public_tokenizers.path("word_bpe_49k.json"), pipeline.KEEP)
    for k in range(150):
        codec.encode(" ".join(f"{chr(97 + n % 26)}{n:x}" for n in range(k * 1000, k * 1000 + 1000)))
    # two generations of chunks and of the few pieces they have in common; all 150,000 were kept before
    assert sum(map(len, (codec.words, codec.words.old, codec.chunks, codec.chunks.old))) < 100_000

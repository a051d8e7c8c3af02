"""The words that the lattice encodes are a choice of speed, not of results."""

import shutil

import public_tokenizers
import sentencepiece

from tarnwork.llm import sentencepieces


def test_pieces_do_not_depend_on_the_frequent_words(spark, tmp_path):
    texts = {i: " ".join(f"word{i % k} once{i}and{k} the" for k in range(1, 9)) + "\n" + "x" * (40 * (i % 3)) for i in range(60)}
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, df = sentencepiece.SentencePieceProcessor(model_file=path), spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for most in (0, 6, 10_000):
        mine = shutil.copy(path, f"{tmp_path}/{most}.model")  # workers keep the words that they know by path
        assert {r["doc_id"]: r["ids"] for r in sentencepieces.encode(df, mine, most).collect()} == {i: library.encode(t) for i, t in texts.items()}

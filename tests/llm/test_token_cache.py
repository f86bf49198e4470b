import pyarrow as pa

from stratavane.llm import token_files


def test_remembered_words_keep_their_ids_over_many_blocks():
    from tokenizers import Tokenizer

    with open(token_files.default_vocabulary(), encoding="utf-8") as f:
        definition = f.read()
    tok = Tokenizer.from_str(definition)
    encoder = token_files.Encoder(definition)
    encoder.known = token_files.Known()
    # words new to the memory in each block, so that its tables are merged more than once, and words of all earlier blocks
    for k in range(40):
        text = " ".join(f"word{j}x{'yz' * (j % 5)}" for j in range(0, 7 * k + 7))
        [(ids, sizes)] = encoder.encode(pa.array([text]))
        want = [*tok.encode(text, add_special_tokens=False).ids, 2]
        assert ids.tolist() == want and sizes.tolist() == [len(want)]

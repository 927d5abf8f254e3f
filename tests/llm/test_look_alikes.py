import pyarrow as pa

from paragram.llm import toxicity
from paragram.llm.textbytes import buffers


def test_look_alike_signs_at_the_ends_and_in_long_words():
    lex = toxicity.Lexicon(frozenset({*toxicity.INSULTS, "asshole", "x" * 70}), frozenset())
    texts = ["$tupid man", "@sshole there", "x" * 35 + "1" + "x" * 34 + " is long", "(hello), world!"]
    lex = toxicity.Lexicon(lex.words | {toxicity.plain(texts[2].split()[0])}, lex.beginnings)
    x = lex.matrix(*buffers(pa.array(texts)))
    f = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert x[0, f["hidden_lexicon"]] == 0.5 and x[0, f["obfuscated"]] == 0.5
    assert x[1, f["hidden_lexicon"]] == 0.5 and x[1, f["obfuscated"]] == 0.5
    assert x[2, f["hidden_lexicon"]] == 1 / 3 and x[2, f["obfuscated"]] == 1 / 3
    assert x[3, f["obfuscated"]] == 0

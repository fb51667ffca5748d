import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from railyard.llm import wordpiece

PATH = public_tokenizers.path("piece_bpe_32k.model")


def greedy(word, first, later):
    """Longest piece first; 0 if some part has no piece."""
    at = n = 0
    while at < len(word):
        pieces = later if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


word = st.text(alphabet="abc", min_size=1, max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.sets(word, max_size=9), st.sets(word, max_size=9), st.lists(st.text(alphabet="abcd", min_size=1, max_size=14), max_size=12))
def test_like_greedy(first, later, words):
    own = wordpiece.LongestMatch(first, later)
    assert [own.count(w) for w in words] == [greedy(w, first, later) for w in words]


def test_frame(spark):
    first, later = map(set, wordpiece.model_pieces(PATH))
    texts = [None, "", " \n", "The thing, in-between 12 x_y", "désolé 日本 ͸", "word " * 20_000, "w" * 30_000, "The thing, in-between 12 x_y"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    for r in wordpiece.count_tokens(df, PATH).collect():
        words = wordpiece.WORD.findall(texts[r.doc_id] or "")
        counts = [greedy(w, first, later) for w in words] if len(texts[r.doc_id] or "") < 100 else [wordpiece.counter(PATH).automaton.count(w) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(counts) + counts.count(0), counts.count(0))
    assert wordpiece.count_tokens(df.limit(0), PATH).count() == 0

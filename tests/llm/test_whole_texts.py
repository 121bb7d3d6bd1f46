"""op3: texts are tokenised whole; a worker's memory doesn't grow with the words that it sees."""

from ledgerspark.llm import training_order


def test_count_is_the_number_of_ids():
    with open(training_order.VOCABULARY, "rb") as f:
        encoder = training_order.Encoder(f.read())
    for text in ["", " ", "a  b\n c", "don't we'll", "x " * 50, "été über 日本語", "\t\ta b."]:
        assert encoder.count(text) == len(encoder.encode(text)) // 2 == len(encoder.model.encode_ordinary(text))
    assert not hasattr(encoder, "__len__")  # no table of words

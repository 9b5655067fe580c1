"""Personal data in long lists: windows lose no text."""

from corpusloom.llm import pii


def _found(text):
    return {text[s:e] for s, _, e in pii.all_spans(text, pii.weights())[1]}


def test_long_number_lists_are_searched_to_their_end():
    phones = [f"{212 + k}-555-{1000 + 37 * k}" for k in range(40)]
    text = "call " + " ".join(phones) + " or write"
    lone = [p for p in phones if p in _found(f"call {p} or write")]
    assert len(lone) == 40
    for a, b in pii.windows(text):
        assert (a, b) == (0, len(text))
    assert len(_found(text) & set(phones)) >= 38


def test_dense_spelled_out_addresses_are_all_found():
    for gap in range(2, 26):
        names = [f"anna{k}(at)mail{k}.org" for k in range(12)]
        text = "".join(f"{n} {'x' * gap} " for n in names)
        assert set(names) <= _found(text), gap


def test_short_defanged_ip_is_searched():
    assert "10[.]0[.]0[.]1" in _found("server 10[.]0[.]0[.]1 is down")

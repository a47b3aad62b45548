from axiomill.operators import parsing


def test_a_long_sentence_is_parsed_to_its_end():
    sentence = " and ".join(f"the ring $R_{{{i}}}$ is a field" for i in range(40))
    assert len(parsing.items(parsing.tagged(sentence))) > 2 * parsing.MOST_ITEMS
    found = parsing.parse(sentence)
    assert len(found) > 1
    assert "$R_{39}$" in " ".join(n.text for n in found)
    assert parsing.parse("") == []


def test_a_sentence_of_fluff_keeps_its_parse():
    assert [n.text for n in parsing.parse("all then also")] == ["then", "also"]

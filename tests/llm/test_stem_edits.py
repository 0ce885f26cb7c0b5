"""Misspellings of words that a stem covers."""

from framewright.llm import toxicity


def test_words_under_a_stem_tolerate_edits():
    forms = ["idiot", "idiots", "idiotic"]
    toxic = [{f"w{k}", f"v{k % 7}", forms[k % 3]} for k in range(300)]
    clean = [{f"w{k}", f"v{k % 7}", "plain"} for k in range(300)]
    words, stems = toxicity.learn_lexicon(toxic, clean)
    assert "idio" in stems
    auto = toxicity.LexiconAutomaton(words, stems)
    # in the first four characters: changed, left out, doubled
    for w in ("1diot", "idot", "iddiot", "1diots", "idotic", "xdiotic"):
        assert auto.match(w)[1] == 2, w
    for w in (*forms, "idiotically", "idiocy", "idiotz"):
        assert auto.match(w)[1] == 1, w
    for w in ("plain", "patriot", "video", "id"):
        assert auto.match(w)[1] == 0, w
    model = toxicity.ToxicModel(words, stems, (1.0, 1.0, 1.0, 0.0, -1.0))
    assert toxicity.Scorer(model).features("you 1diot")[1] > 0

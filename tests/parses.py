"""Hand-written parses for the extraction rules.

A word is written ``text/POS/dep/head`` or ``text|lemma/POS/dep/head``; a chunk is
``(start, end, root)``. The words are our own sentences of the kinds the rules describe.
"""


def document(doc_id, words, chunks):
    tokens = []
    for i, word in enumerate(words.split()):
        form, pos, dep, head = word.split("/")
        text, _, lemma = form.partition("|")
        tokens.append((i, text, lemma or text.lower(), pos, dep, int(head), True))
    texts, lemmas = [t[1] for t in tokens], [t[2] for t in tokens]
    noun_chunks = [
        (n, a, b, r, " ".join(texts[a:b]), " ".join(lemmas[a:b])) for n, (a, b, r) in enumerate(chunks)
    ]
    return (doc_id, tokens, noun_chunks)


# doc_id -> (words, chunks, expected relations as (subject, relation, object) entity indexes)
RULES = {
    "active": (
        "Two/NUM/nummod/1 painters|painter/NOUN/nsubj/3 are|be/AUX/aux/3 repairing|repair/VERB/ROOT/3 a/DET/det/5 wall/NOUN/dobj/3 "
        "under/ADP/prep/3 the/DET/det/8 bridge/NOUN/pobj/6",
        [(0, 2, 1), (4, 6, 5), (7, 9, 8)],
        [(0, "repairing", 1), (0, "under", 2)],
    ),
    "clausal": (
        "Some/DET/det/1 tourists|tourist/NOUN/ROOT/1 feeding|feed/VERB/acl/1 pigeons|pigeon/NOUN/dobj/2 near/ADP/prep/2 "
        "a/DET/det/6 fountain/NOUN/pobj/4",
        [(0, 2, 1), (3, 4, 3), (5, 7, 6)],
        [(0, "feeding", 1), (0, "near", 2)],
    ),
    "attribute": (
        "Our/PRON/poss/1 neighbour/NOUN/nsubj/2 became|become/VERB/ROOT/2 mayor/NOUN/attr/2",
        [(0, 2, 1), (3, 4, 3)],
        [(0, "became", 1)],
    ),
    "passive": (
        "Both/DET/det/1 letters|letter/NOUN/nsubjpass/3 were|be/AUX/auxpass/3 signed|sign/VERB/ROOT/3 yesterday/NOUN/npadvmod/3 "
        "by/ADP/agent/3 an/DET/det/7 officer/NOUN/pobj/5",
        [(0, 2, 1), (6, 8, 7)],
        [(1, "signed", 0)],
    ),
    "phrasal_verb": (
        "travellers|traveller/NOUN/nsubj/1 wait/VERB/ROOT/1 for/ADP/prep/1 late/ADJ/amod/4 buses|bus/NOUN/pobj/2",
        [(0, 1, 0), (3, 5, 4)],
        [(0, "wait for", 1)],
    ),
    "verb_preposition": (
        "The/DET/det/1 goat/NOUN/nsubj/2 climbed|climb/VERB/ROOT/2 over/ADP/prep/2 wet/ADJ/amod/5 rocks|rock/NOUN/pobj/3",
        [(0, 2, 1), (4, 6, 5)],
        [(0, "over", 1)],
    ),
    "phrasal_preposition": (
        "bicycles|bicycle/NOUN/ROOT/0 on/ADP/prep/0 top/NOUN/pobj/1 of/ADP/prep/2 a/DET/det/5 shed/NOUN/pobj/3",
        [(0, 1, 0), (2, 3, 2), (4, 6, 5)],
        # "on" stands between nouns before the phrase is seen; "top" is no noun afterwards
        [(0, "on top of", 1)],
    ),
    "noun_preposition": (
        "Seven/NUM/nummod/1 apples|apple/NOUN/ROOT/1 from/ADP/prep/1 a/DET/det/4 basket/NOUN/pobj/2",
        [(0, 2, 1), (3, 5, 4)],
        [(0, "from", 1)],
    ),
    "modifier_of_noun": (
        "A/DET/det/1 lighthouse/NOUN/ROOT/1 visible/ADJ/amod/1 across/ADP/prep/2 the/DET/det/5 bay/NOUN/pobj/3",
        [(0, 2, 1), (4, 6, 5)],
        [(0, "visible across", 1)],
    ),
    "modifier_of_verb": (
        "children|child/NOUN/ROOT/0 sleeping|sleep/VERB/acl/0 far/ADV/advmod/1 from/ADP/prep/2 their/PRON/poss/5 parents|parent/NOUN/pobj/3",
        [(0, 1, 0), (4, 6, 5)],
        [(0, "far from", 1)],
    ),
    "copula": (
        "Those/DET/det/1 keys|key/NOUN/nsubj/2 were|be/AUX/ROOT/2 behind/ADP/prep/2 the/DET/det/5 clock/NOUN/pobj/3",
        [(0, 2, 1), (4, 6, 5)],
        [(0, "behind", 1)],
    ),
    # the phrase hangs on a verb: the verb is in no chunk and "top" is dropped, so nothing is left
    "fake_noun_on_verb": (
        "cats|cat/NOUN/ROOT/0 resting|rest/VERB/acl/0 on/ADP/prep/1 top/NOUN/pobj/2 of/ADP/prep/3 a/DET/det/6 car/NOUN/pobj/4",
        [(0, 1, 0), (3, 4, 3), (5, 7, 6)],
        [],
    ),
    # two subjects for one verb: the later one decides
    "later_subject": (
        "man/NOUN/nsubj/2 dog/NOUN/nsubj/2 chases|chase/VERB/ROOT/2 cat/NOUN/dobj/2",
        [(0, 1, 0), (1, 2, 1), (3, 4, 3)],
        [(1, "chases", 2)],
    ),
    # conjuncts are followed one level deep only
    "conjuncts": (
        "man/NOUN/nsubj/7 and/CCONJ/cc/0 dog/NOUN/conj/0 and/CCONJ/cc/2 cow/NOUN/conj/2 and/CCONJ/cc/4 cat/NOUN/conj/4 "
        "eat/VERB/ROOT/7 bread/NOUN/dobj/7 and/CCONJ/cc/8 fish/NOUN/conj/8",
        [(0, 1, 0), (2, 3, 2), (4, 5, 4), (6, 7, 6), (8, 9, 8), (10, 11, 10)],
        [(0, "eat", 4), (0, "eat", 5), (1, "eat", 4), (1, "eat", 5)],
    ),
    # no subject for the verb: falls through to no branch
    "no_subject": (
        "running|run/VERB/ROOT/0 in/ADP/prep/0 the/DET/det/3 park/NOUN/pobj/1",
        [(2, 4, 3)],
        [],
    ),
    # a verb-labelled dependency never occurs, so the branch that asks for it adds nothing
    "verb_labelled_dep": (
        "cat/NOUN/nsubj/1 odd/X/VERB/1 in/ADP/prep/1 box/NOUN/pobj/2",
        [(0, 1, 0), (3, 4, 3)],
        [],
    ),
}

# doc_id -> (words, chunks, expected entities as (head, lemma_head, [(dep, span)], type))
ENTITIES = {
    "siblings_reversed": (
        "park/NOUN/compound/2 oak/NOUN/compound/2 trees|tree/NOUN/ROOT/2",
        [(0, 3, 2)],
        [("oak park trees", "oak park tree", [], "unknown")],
    ),
    "compound_chain": (
        "kitchen/NOUN/compound/1 counter/NOUN/compound/2 top/NOUN/ROOT/2",
        [(0, 3, 2)],
        [("kitchen counter top", "kitchen counter top", [], "unknown")],
    ),
    # d under b, a and b under c: depth first gives a, b, d - each put in front
    "mixed_tree": (
        "a/NOUN/compound/3 d/NOUN/compound/2 b/NOUN/compound/3 c/NOUN/ROOT/3",
        [(0, 4, 3)],
        [("d b a c", "d b a c", [], "unknown")],
    ),
    "compound_with_determiner": (
        "the/DET/det/1 city/NOUN/compound/3 two|two/NUM/nummod/3 streets|street/NOUN/ROOT/3",
        [(0, 4, 3)],
        [("city streets", "city street", [("det", "the"), ("nummod", "two")], "scene")],
    ),
    "coordinated_adjectives": (
        "a/DET/det/5 big/ADJ/amod/5 red/ADJ/conj/1 old/ADJ/conj/1 wet/ADJ/conj/3 ball/NOUN/ROOT/5",
        [(0, 6, 5)],
        [("ball", "ball", [("det", "a"), ("amod", "big"), ("amod", "red"), ("amod", "old")], "unknown")],
    ),
    "scene_whole_and_case": (
        "Kitchen|Kitchen/PROPN/ROOT/0 kitchen/NOUN/conj/0",
        [(0, 1, 0), (1, 2, 1)],
        [("Kitchen", "Kitchen", [], "unknown"), ("kitchen", "kitchen", [], "scene")],
    ),
    "pronoun": (
        "it|-PRON-/PRON/nsubj/1 is|be/AUX/ROOT/1 a/DET/det/3 dog/NOUN/attr/1",
        [(0, 1, 0), (2, 4, 3)],
        [("dog", "dog", [("det", "a")], "unknown")],
    ),
    "pronoun_tagged": (
        "it/PRON/nsubj/1 is|be/AUX/ROOT/1 a/DET/det/3 dog/NOUN/attr/1",
        [(0, 1, 0), (2, 4, 3)],
        [("it", "it", [], "unknown"), ("dog", "dog", [("det", "a")], "unknown")],
    ),
}

"""Scene graphs from token documents.

Input: one row per document with two arrays

    tokens  array<struct<i, text, lemma, pos, dep, head_i, ws>>      i = position in the array
    chunks  array<struct<chunk_id, start, end, root_i, text, lemma>> noun chunks, half-open

Output: the same rows with ``entities`` and ``relations`` arrays. A document never needs
another document's rows, so the whole extraction is column work: no exchange, no join, no
Python. Look-ups by token position go through ``keyed`` arrays, which keeps the cost per
document linear (times logs for sorting and for chains of compounds) however long the text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import computed, entries_of, first_of, index_of, indices, keyed, last, last_of, let, listed
from plumbline.functions.text import last_word
from plumbline.sources.lexicons import document_hits, lexicon_table, lexicon_values

TOKEN = "struct<i:int,text:string,lemma:string,pos:string,dep:string,head_i:int,ws:boolean>"
TOKENS = f"array<{TOKEN}>"
CHUNK = "struct<chunk_id:int,start:int,end:int,root_i:int,text:string,lemma:string>"
CHUNKS = f"array<{CHUNK}>"
MODIFIER = "struct<dep:string,span:string,lemma_span:string>"
ENTITY = (
    "struct<span:string,lemma_span:string,head:string,lemma_head:string,"
    f"span_bounds:struct<start:int,end:int>,modifiers:array<{MODIFIER}>,type:string>"
)
RELATION = "struct<subject:int,object:int,relation:string,lemma_relation:string>"

# Labels of the dependency scheme the rules look at.
_MODIFIER_DEPS = ("amod", "det", "nummod")
_PRONOUN_LEMMA = "-PRON-"


def span_text(tokens: Column, start: Column, end: Column, field: str = "text") -> Column:
    """Text (or lemmas) of tokens [start, end), with the document's own spacing."""
    part = F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))
    spaced = F.array_join(
        F.transform(
            part,
            lambda t: F.concat(t[field], F.when(F.coalesce(t["ws"], F.lit(True)), F.lit(" ")).otherwise(F.lit(""))),
        ),
        "",
    )
    return F.rtrim(spaced)


def _children(tokens: Column, deps: tuple[str, ...]) -> Column:
    # the sentence root heads itself and is nobody's child
    def labelled(t: Column) -> Column:
        # inside lambdas a chain of tests takes less time than a list
        return reduce(or_, [t["dep"] == dep for dep in deps])

    return F.filter(tokens, lambda t: labelled(t) & (t["head_i"] != t["i"]))


def _conjuncts(tokens: Column) -> Column:
    """Per head position, the tokens directly coordinated with it (one level)."""
    return keyed(
        F.transform(
            _children(tokens, ("conj",)), lambda t: F.struct(t["head_i"].alias("k"), t["i"].alias("i"))
        )
    )


def _phrase_members(df: DataFrame, tokens: Column, chunks: Column) -> DataFrame:
    """Add ``_members``: per chunk root, its modifiers and compounds, reached directly or through compounds, depth first;
    and ``_compounds``: whether there are compounds at all.

    A token hangs on its head and, if that is a compound, on what the compound hangs on. Where nothing hangs on a
    compound, members are the children in their order. Where chains have up to ``CHAIN`` compounds, as nearly everywhere, what hangs
    on a compound is put in behind it; for longer ones see ``_ranked_members``.
    """
    relevant = _children(tokens, (*_MODIFIER_DEPS, "compound"))
    children, direct = F.col("_children"), F.col("_direct")
    steps = computed(df, {"_children": F.sort_array(F.transform(relevant, lambda t: _member(t["head_i"], t["i"], t)))})
    compounds = F.coalesce(F.exists(children, lambda m: m["compound"]), F.lit(False))
    steps = computed(steps, {"_compounds": compounds, "_direct": index_of(children)})
    # compounds on which something hangs
    above = F.filter(children, lambda m: m["compound"] & (F.size(entries_of(direct, m["i"])) > 0))
    steps = computed(steps, {"_above": F.when(F.col("_compounds"), above)})
    members = (
        F.when(F.coalesce(F.size("_above"), F.lit(0)) == 0, direct)
        .when(F.exists("_above", lambda m: _is_deep(tokens, m["i"], CHAIN)), keyed(_ranked_members(tokens, chunks, relevant)))
        .otherwise(let(F.flatten(F.transform(children, lambda m: _with_hanging(direct, m, None, CHAIN))), index_of))
    )
    return computed(steps, {"_members": members}).drop("_children", "_direct", "_above")


# Chains of so many compounds are followed step by step.
CHAIN = 3


def _is_deep(tokens: Column, compound: Column, steps: int) -> Column:
    """Whether more than so many compounds follow each other from this one up."""
    head = F.get(tokens, compound)["head_i"]
    above = _is_compound(tokens, head)
    return above if steps == 1 else above & _is_deep(tokens, head, steps - 1)


def _with_hanging(direct: Column, m: Column, root: Column | None, steps: int) -> Column:
    """A member and, if it is a compound, behind it what hangs on it, depth first, all as members of ``root`` (its own if None)."""
    own = F.array(m if root is None else m.withField("k", root))
    if steps == 0:
        return own
    top = m["k"] if root is None else root
    below = F.flatten(F.transform(entries_of(direct, m["i"]), lambda x: _with_hanging(direct, x, top, steps - 1)))
    return F.when(m["compound"], F.concat(own, below)).otherwise(own)


def _member(root: Column, rank: Column, t: Column) -> Column:
    return F.struct(root.alias("k"), rank.cast("long").alias("rank"), t["i"].alias("i"), (t["dep"] == "compound").alias("compound"))


def _is_compound(tokens: Column, i: Column) -> Column:
    t = F.get(tokens, i)
    return F.coalesce((t["dep"] == "compound") & (t["head_i"] != i), F.lit(False))


def _rounds(steps: Column) -> Column:
    """An array as long as doublings that reach the given number of steps."""
    return F.array_repeat(F.lit(0), F.ceil(F.log2(F.greatest(steps, F.lit(1)) + 1)).cast("int"))


def _ranked_members(tokens: Column, chunks: Column, relevant: Column) -> Column:
    """Members of chunk roots through chains of compounds of any length, each with its rank depth first.

    Everything goes by pointer doubling: after round n every token knows what lies 2^n compounds above it, so the rounds
    that do anything are the logarithm of the longest chain and each is linear (with a sort). A token's subtree is counted by adding, round by
    round, the counts of those whose pointer arrives at it; the counts of earlier siblings give its place below its
    parent, and places added up along the way its rank. Roots above a token are found by the same doubling.
    """
    def pointer(t: Column) -> Column:
        return F.when(_is_compound(tokens, t["head_i"]) & (t["head_i"] != t["i"]), t["head_i"]).otherwise(F.lit(-1))

    def counts(t: Column) -> Column:
        return (t["dep"].isin(*_MODIFIER_DEPS, "compound") & (t["head_i"] != t["i"])).cast("int")

    # no chain is longer than there are compounds above compounds
    chain = F.size(F.filter(_children(tokens, ("compound",)), lambda t: _is_compound(tokens, t["head_i"]))) + 1
    doublings = _rounds(chain)

    def doubled(start: Column, step: Callable[[Column], Column]) -> Column:
        # no pointer left: nothing changes any more
        return F.aggregate(
            doublings, start, lambda state, _: F.when(F.exists(state["jump"], lambda j: j >= 0), step(state)).otherwise(state)
        )

    def jumped(jump: Column) -> Column:
        return F.transform(jump, lambda j: F.when(j >= 0, F.get(jump, j)).otherwise(F.lit(-1)))

    def counted(state: Column) -> Column:
        arrived = F.filter(
            F.transform(state["jump"], lambda j, u: F.struct(j.alias("k"), F.get(state["n"], u).alias("n"))), lambda x: x["k"] >= 0
        )
        more = let(
            keyed(arrived),
            lambda index: F.transform(state["n"], lambda n, i: n + F.aggregate(entries_of(index, i), F.lit(0), lambda s, x: s + x["n"])),
        )
        return F.struct(jumped(state["jump"]).alias("jump"), more.alias("n"))

    def sizes(pointers: Column) -> Column:
        start = F.struct(pointers.alias("jump"), F.transform(tokens, counts).alias("n"))
        return doubled(start, counted)["n"]

    def siblings(size: Column) -> Column:
        return F.sort_array(F.transform(relevant, lambda t: F.struct(t["head_i"].alias("k"), t["i"].alias("i"), F.get(size, t["i"]).alias("n"))))

    def offsets(held: Column) -> Column:
        """Per position, one more than the tokens below earlier siblings: running sums within equal keys, by doubling."""

        def step(state: Column) -> Column:
            def added(n: Column, j: Column) -> Column:
                back = j - state["step"]
                return F.when((back >= 0) & (F.get(held, back)["k"] == F.get(held, j)["k"]), n + F.get(state["sum"], back)).otherwise(n)

            # a round that adds nothing is the last one: no key has as many entries
            return let(
                F.transform(state["sum"], added),
                lambda sums: F.struct((state["step"] * 2).alias("step"), (sums != state["sum"]).alias("more"), sums.alias("sum")),
            )

        start = F.struct(F.lit(1).alias("step"), F.lit(True).alias("more"), F.transform(held, lambda x: x["n"]).alias("sum"))
        sums = F.aggregate(_rounds(F.size(held)), start, lambda state, _: F.when(state["more"], step(state)).otherwise(state))["sum"]
        placed = let(sums, lambda total: F.transform(held, lambda x, j: F.struct(x["i"].alias("k"), (F.get(total, j) - x["n"] + 1).alias("off"))))
        return let(keyed(placed), lambda index: F.transform(indices(tokens), lambda i: F.coalesce(first_of(index, i)["off"], F.lit(0))))

    def climbed(state: Column) -> Column:
        def added(field: str) -> Column:
            def add(n: Column, i: Column) -> Column:
                j = F.get(state["jump"], i)
                return F.when(j >= 0, n + F.get(state[field], j)).otherwise(n)

            return F.transform(state[field], add)

        return F.struct(
            jumped(state["jump"]).alias("jump"),
            added("rank").alias("rank"),
            added("passed").alias("passed"),
            F.transform(state["root"], lambda r: F.get(state["root"], r)).alias("root"),
        )

    def with_roots(is_chunk_root: Column) -> Column:
        def is_root(i: Column) -> Column:
            return F.coalesce(F.get(is_chunk_root, i), F.lit(False))

        def next_root(t: Column) -> Column:
            # where a climb from here stops at once: at a chunk's root, and above the last compound
            return F.when(is_root(t["i"]) | ~_is_compound(tokens, t["i"]), t["i"]).otherwise(t["head_i"])

        def members(state: Column) -> Column:
            def root_at(i: Column) -> Column:
                found = F.get(state["root"], i)
                return F.when(is_root(found), found)

            def above(t: Column) -> Column:
                # roots that are compounds themselves pass members on: a step for each of those above the token
                def on(way: Column) -> Column:
                    top = last(way)
                    return F.when(_is_compound(tokens, top), F.concat(way, F.array(root_at(F.get(tokens, top)["head_i"])))).otherwise(way)

                steps = F.array_repeat(F.lit(0), F.get(state["passed"], t["i"]))
                return F.aggregate(steps, F.array(root_at(t["head_i"])), lambda way, _: on(way))

            def entries(t: Column) -> Column:
                ways = F.filter(F.array_distinct(above(t)), lambda r: r.isNotNull())
                return F.transform(ways, lambda r: _member(r, F.get(state["rank"], t["i"]), t))

            return F.flatten(F.transform(relevant, entries))

        def ranked(pointers: Column) -> Column:
            places = let(let(sizes(pointers), siblings), offsets)
            start = F.struct(
                pointers.alias("jump"), places.alias("rank"), F.transform(pointers, lambda j: is_root(j).cast("int")).alias("passed"),
                F.transform(tokens, next_root).alias("root"),
            )
            return let(doubled(start, climbed), members)

        return let(F.transform(tokens, pointer), ranked)

    def flags(roots: Column) -> Column:
        return F.transform(indices(tokens), lambda i: F.size(entries_of(roots, i)) > 0)

    return let(let(keyed(F.transform(chunks, lambda c: F.struct(c["root_i"].alias("k")))), flags), with_roots)


def _subjects(tokens: Column) -> Column:
    """Per verb position, its subjects by the token that names them."""

    def entry(t: Column) -> Column:
        head = F.get(tokens, t["head_i"])
        above = F.get(tokens, head["head_i"])

        def row(verb: Column, subject: Column) -> Column:
            return F.struct(verb.alias("k"), t["i"].alias("by"), subject.alias("subject"))

        return (
            F.when(t["dep"] == "nsubj", row(t["head_i"], t["i"]))
            .when(t["dep"] == "acl", row(t["i"], t["head_i"]))
            .when(
                (t["dep"] == "pobj") & (head["dep"] == "agent") & (above["pos"] == "VERB"),
                row(head["head_i"], t["i"]),
            )
        )

    triggers = F.filter(tokens, lambda t: t["dep"].isin("nsubj", "acl", "pobj"))
    return keyed(F.filter(F.transform(triggers, entry), lambda e: e.isNotNull()))


# Whether a phrase is listed.
Listed = Callable[[Column], Column]


def _object_ancestors(tokens: Column, chunks: Column) -> Column:
    """Roots of the chunks that are objects, with the three positions above each."""

    def ancestors(c: Column) -> Column:
        def above(i: Column) -> Column:
            return F.get(tokens, i)["head_i"]

        i1 = above(c["root_i"])
        return F.struct(
            c["root_i"].alias("i0"), i1.alias("i1"), above(i1).alias("i2"), above(above(i1)).alias("i3")
        )

    objects = F.filter(
        chunks, lambda c: F.get(tokens, c["root_i"])["dep"].isin("dobj", "attr", "nsubjpass", "pobj")
    )
    return F.transform(objects, ancestors)


def _asked_phrases(tokens: Column, chunks: Column) -> dict[str, Column]:
    """The phrases that ``_found`` looks up: verbs with a particle, and prepositions around a noun."""

    def of_prepositions(phrase: Callable[[Column], Column]) -> Column:
        ups = F.filter(_object_ancestors(tokens, chunks), lambda up: F.get(tokens, up["i0"])["dep"] == "pobj")
        return F.filter(F.transform(ups, phrase), lambda x: x.isNotNull())

    def verb(up: Column) -> Column:
        h1, h2 = F.get(tokens, up["i1"]), F.get(tokens, up["i2"])
        return F.when((h2["pos"] == "VERB") & (up["i2"] + 1 == up["i1"]), F.concat(h2["lemma"], F.lit(" "), h1["lemma"]))

    def preposition(up: Column) -> Column:
        h2 = F.get(tokens, up["i2"])
        return F.when(h2["dep"] == "pobj", F.lower(span_text(tokens, up["i3"], up["i1"] + 1)))

    return {"verbs": of_prepositions(verb), "preps": of_prepositions(preposition)}


def _found(tokens: Column, chunks: Column, subjects: Column, is_phrasal_verb: Listed, is_phrasal_prep: Listed) -> Column:
    """The relation each chunk's root takes part in as object, by token position.

    The order of the branches matters.
    """

    def relation(subject: Column, object_: Column, text: Column, lemma: Column, fake: Column | None = None) -> Column:
        return F.struct(
            subject.alias("subject"),
            object_.alias("object"),
            text.alias("relation"),
            lemma.alias("lemma_relation"),
            (F.lit(None).cast("int") if fake is None else fake).alias("fake"),
        )

    def subject_of(i: Column) -> Column:
        # of several subjects the latest token decides
        return last_of(subjects, i)["subject"]

    def of_root(up: Column) -> Column:
        r, h1, h2, h3 = (F.get(tokens, up[name]) for name in ("i0", "i1", "i2", "i3"))
        subject = subject_of(up["i2"])

        def by(who: Column, text: Column, lemma: Column, fake: Column | None = None) -> Column:
            return relation(who, up["i0"], text, lemma, fake)

        def both(field: str) -> Column:
            return F.concat(h2[field], F.lit(" "), h1[field])

        by_preposition = (h1["text"], h1["lemma"])
        by_two_words = (both("text"), both("lemma"))
        phrase = span_text(tokens, up["i3"], up["i1"] + 1)
        modifier = h2["dep"].isin("amod", "advmod")
        return (
            F.when(
                r["dep"] != "pobj",
                F.when(subject_of(up["i1"]).isNotNull(), by(subject_of(up["i1"]), *by_preposition)),
            )
            .when(h1["dep"] == "agent", F.lit(None))
            .when(
                (h2["pos"] == "VERB")
                & (up["i2"] + 1 == up["i1"])
                & is_phrasal_verb(both("lemma"))
                & subject.isNotNull(),
                by(subject, *by_two_words),
            )
            .when(
                ((h2["pos"] == "VERB") | (h2["dep"] == "acl")) & subject.isNotNull(),
                by(subject, *by_preposition),
            )
            .when(
                (h2["dep"] == "pobj") & is_phrasal_prep(F.lower(phrase)),
                # the lemma stops one token short of the text
                by(h3["head_i"], phrase, span_text(tokens, up["i3"], up["i1"], "lemma"), fake=up["i2"]),
            )
            .when(h2["pos"] == "NOUN", by(up["i2"], *by_preposition))
            .when(modifier & (h3["pos"] == "NOUN"), by(up["i3"], *by_two_words))
            .when(
                modifier & (h3["pos"] == "VERB") & subject_of(up["i3"]).isNotNull(),
                by(subject_of(up["i3"]), *by_two_words),
            )
            .when((h2["pos"] == "AUX") & subject.isNotNull(), by(subject, *by_preposition))
        )

    return F.filter(F.transform(_object_ancestors(tokens, chunks), of_root), lambda x: x.isNotNull())


def _kept(tokens: Column, chunks: Column, found: Column | None, drop_pronouns: bool) -> Column:
    """Chunks that are entities: no pronouns, no nouns used up by a phrasal preposition (in ``found``)."""

    def is_pronoun(chunk: Column) -> Column:
        root = F.get(tokens, chunk["root_i"])
        hit = root["lemma"] == _PRONOUN_LEMMA
        if drop_pronouns:
            hit = hit | (root["pos"] == "PRON")
        return F.coalesce(hit, F.lit(False))

    def real(marks: Column) -> Column:
        return F.filter(chunks, lambda x: ~is_pronoun(x) & (F.size(entries_of(marks, x["root_i"])) == 0))

    if found is None:
        return F.filter(chunks, lambda x: ~is_pronoun(x))
    marked = F.filter(found, lambda x: x["fake"].isNotNull())
    return let(keyed(F.transform(marked, lambda x: F.struct(x["fake"].alias("k")))), real)


def _name(tokens: Column, root: Column, mine: Column, compounded: Column, field: str) -> Column:
    # each compound is put in front of what is there, so they end up reversed
    compounds = F.filter(mine, lambda m: m["compound"])
    texts = F.transform(compounds, lambda m: F.get(tokens, m["i"])[field])
    return F.when(
        compounded & F.exists(mine, lambda m: m["compound"]),
        F.array_join(F.concat(F.reverse(texts), F.array(root[field])), " "),
    ).otherwise(root[field])


def _head(c: Column, mine: Column, tokens: Column, compounded: Column, field: str) -> Column:
    """The name of a chunk with the members ``mine``. Most chunks have none."""
    root = F.get(tokens, c["root_i"])
    return F.when(F.size(mine) == 0, root[field]).otherwise(_name(tokens, root, mine, compounded, field))


def _names(c: Column, mine: Column, tokens: Column, compounded: Column) -> Column:
    return F.struct(*[_head(c, mine, tokens, compounded, field).alias(field) for field in ("text", "lemma")])


def _asked_nouns(tokens: Column, chunks: Column, members: Column, compounded: Column) -> Column:
    """The nouns that ``_type`` looks up, and their last words, of all chunks, also those that become no entities."""

    def noun(c: Column) -> Column:
        return let(entries_of(members, c["root_i"]), lambda mine: _head(c, mine, tokens, compounded, "lemma"))

    return let(F.array_distinct(F.transform(chunks, noun)), lambda nouns: F.concat(nouns, F.transform(nouns, last_word)))


def _entity(c: Column, mine: Column, names: Column, tokens: Column, compounded: Column, conjuncts: Column, is_scene: Listed) -> Column:
    """The entity of a chunk with the members ``mine``; ``compounded``: whether the document has compounds."""

    def modifier(i: Column, dep: Column) -> Column:
        t = F.get(tokens, i)
        return F.struct(dep.alias("dep"), t["text"].alias("span"), t["lemma"].alias("lemma_span"))

    def with_conjuncts(i: Column) -> Column:
        # an adjective brings the adjectives coordinated with it along
        dep = F.get(tokens, i)["dep"]
        more = F.when(dep == "amod", F.transform(entries_of(conjuncts, i), lambda y: modifier(y["i"], dep)))
        return F.concat(F.array(modifier(i, dep)), F.coalesce(more, F.array().cast(f"array<{MODIFIER}>")))

    def listed_(plain: Column) -> Column:
        return F.when(
            F.size(conjuncts["entries"]) == 0,
            F.transform(plain, lambda m: modifier(m["i"], F.get(tokens, m["i"])["dep"])),
        ).otherwise(F.flatten(F.transform(plain, lambda m: with_conjuncts(m["i"]))))

    plain = F.when(compounded, F.filter(mine, lambda m: ~m["compound"])).otherwise(mine)
    # most chunks have no members
    modifiers = F.when(F.size(mine) == 0, F.array().cast(f"array<{MODIFIER}>")).otherwise(listed_(plain))

    return F.struct(
        c["text"].alias("span"),
        c["lemma"].alias("lemma_span"),
        names["text"].alias("head"),
        names["lemma"].alias("lemma_head"),
        F.struct(c["start"].alias("start"), c["end"].alias("end")).alias("span_bounds"),
        modifiers.alias("modifiers"),
        _type(names["lemma"], is_scene).alias("type"),
    )


def is_scene_noun(noun: Column, scene_nouns: list[str]) -> Column:
    """The whole noun or its last word is listed; case matters."""
    if not scene_nouns:
        return F.lit(False)
    return _is_scene(noun, lambda c: c.isin(scene_nouns))


def _is_scene(noun: Column, listed_: Listed) -> Column:
    # a noun without a space is its own last word
    return F.coalesce(listed_(noun) | (noun.contains(" ") & listed_(last_word(noun))), F.lit(False))


def _type(noun: Column, is_scene: Listed) -> Column:
    return F.when(is_scene(noun), F.lit("scene")).otherwise(F.lit("unknown"))


def _locations(kept: Column) -> Column:
    """Per token position, the index of the first kept chunk that covers it."""
    nowhere = F.array().cast("array<int>")

    def previous_end(n: Column) -> Column:
        return F.coalesce(F.get(kept, n - 1)["end"], F.lit(0))

    def in_order(n: Column) -> Column:
        c = F.get(kept, n)
        return (c["start"] >= previous_end(n)) & (c["end"] >= c["start"])

    # noun chunks follow each other without overlap: lay their indexes out side by side
    side_by_side = F.flatten(
        F.transform(
            kept,
            lambda c, n: F.concat(
                F.array_repeat(F.lit(None).cast("int"), c["start"] - previous_end(n)),
                F.array_repeat(n, c["end"] - c["start"]),
            ),
        )
    )

    def cover(c: Column, n: Column) -> Column:
        positions = F.sequence(c["start"], c["end"] - 1)
        return F.when(
            c["end"] > c["start"], F.transform(positions, lambda p: F.struct(p.alias("k"), n.alias("n")))
        ).otherwise(F.array().cast("array<struct<k:int,n:int>>"))

    def first_cover(index: Column) -> Column:
        return F.transform(indices(index["starts"]), lambda p: first_of(index, p)["n"])

    return (
        F.when(F.size(kept) == 0, nowhere)
        .when(F.forall(indices(kept), in_order), side_by_side)
        .otherwise(let(keyed(F.flatten(F.transform(kept, cover))), first_cover))
    )


def _located(found: Column, conjuncts: Column, where: Column) -> Column:
    """Spread each relation over the conjuncts of its ends and map positions to entities."""
    ends = F.transform(
        _spread(found, conjuncts),
        lambda r: r.withField("subject", F.get(where, r["subject"])).withField("object", F.get(where, r["object"])),
    )
    return F.filter(ends, lambda r: r["subject"].isNotNull() & r["object"].isNotNull())


def _spread(found: Column, conjuncts: Column) -> Column:
    """Each relation once for every pair of its ends and their conjuncts, by token position."""

    def with_conjuncts(i: Column) -> Column:
        return F.concat(F.array(i), F.transform(entries_of(conjuncts, i), lambda y: y["i"]))

    def spread(x: Column) -> Column:
        return F.flatten(
            F.transform(
                with_conjuncts(x["subject"]),
                lambda s: F.transform(
                    with_conjuncts(x["object"]),
                    lambda o: F.struct(
                        s.alias("subject"),
                        o.alias("object"),
                        x["relation"].alias("relation"),
                        x["lemma_relation"].alias("lemma_relation"),
                    ),
                ),
            )
        )

    return F.flatten(F.transform(found, spread))


def extract_scene_graph(
    df: DataFrame,
    *,
    phrasal_verbs: DataFrame | Iterable[str] = (),
    phrasal_preps: DataFrame | Iterable[str] = (),
    scene_nouns: DataFrame | Iterable[str] = (),
    tokens: str = "tokens",
    chunks: str = "chunks",
    drop_pronouns: bool = False,
    keep_tokens: bool = True,
    want: tuple[str, ...] = ("entities", "relations"),
    inline_entries: int | None = None,
    parse: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``entities`` and ``relations`` to token documents, or the one of them that is wanted.

    Pronoun chunks are dropped when their root has the placeholder lemma of older parsers;
    ``drop_pronouns`` also drops those tagged PRON. ``keep_tokens=False`` drops the parse.

    Word lists of up to ``inline_entries`` are part of the expressions. A longer one is joined: the phrases that
    a document asks for meet the list by hash, and the document gets those that are listed. Rows are written for that.
    A parse is many times the size of its text: with ``parse``, which adds it to the rows of ``df``, rows are
    written and joined without it, and parsed again. ``parse`` gives equal parses for equal rows.
    """
    verbs, preps, scenes = (lexicon_values(x, inline_entries) for x in (phrasal_verbs, phrasal_preps, scene_nouns))
    t, c = F.col(tokens), F.col(chunks)
    spark = df.sparkSession
    relations, named = "relations" in want, "entities" in want
    given = {"verbs": (verbs, phrasal_verbs), "preps": (preps, phrasal_preps), "scenes": (scenes, scene_nouns)}
    if not {"relations", "positions"} & set(want):  # verbs decide about relations alone
        given.pop("verbs")
    if not named:
        given.pop("scenes")
    long_lists = {k: lexicon_table(spark, x) for k, (values, x) in given.items() if values is None}
    if long_lists:

        def asking(rows: DataFrame) -> DataFrame:
            rows = rows if parse is None else parse(rows)
            if "scenes" in long_lists:
                rows = _phrase_members(rows, t, c)
                rows = computed(rows, {"_nouns": _asked_nouns(t, c, F.col("_members"), F.col("_compounds"))})
            return rows

        asked = {**_asked_phrases(t, c), "scenes": F.col("_nouns")}
        df = document_hits(df, {f"_{k}": (asked[k], table) for k, table in long_lists.items()}, asking, even=parse is not None)
    if parse is not None:
        df = parse(df)

    def member(name: str, values: list[str] | None) -> Listed:
        if values is None and name in long_lists:
            return lambda phrase: F.array_contains(f"_{name}", phrase)
        return lambda phrase: phrase.isin(values or [])

    scene = (lambda noun: is_scene_noun(noun, scenes)) if scenes is not None else (lambda noun: _is_scene(noun, member("scenes", scenes)))
    subjects, conjuncts, members, found, kept, where = (
        F.col(n) for n in ("_subjects", "_conjuncts", "_members", "_found", "_kept", "_where")
    )
    columns = [col for col in df.columns if col not in ("_verbs", "_preps", "_scenes")]
    # without phrasal prepositions no noun is used up, so entities alone need no relations
    finding = relations or "positions" in want or preps is None or bool(preps)
    first = {"_subjects": _subjects(t)} if finding else {}
    if relations or named or "positions" in want:
        first["_conjuncts"] = _conjuncts(t)
    steps = computed(df, first)
    if named:
        steps = _phrase_members(steps, t, c)
    if finding:
        steps = computed(steps, {"_found": _found(t, c, subjects, member("verbs", verbs), member("preps", preps))}).drop("_subjects")
    steps = computed(steps, {"_kept": _kept(t, c, found if finding else None, drop_pronouns)})
    if relations:
        steps = computed(steps, {"_where": _locations(kept)})
    if "positions" in want:
        spread_out = {"relation_positions": _spread(found, conjuncts), "entity_spans": _spans(kept)}
        return computed(steps, spread_out).select(*columns, *spread_out).drop(*([] if keep_tokens else [tokens, chunks]))
    made = {}
    if named:
        steps = computed(steps, {"_mine": F.transform(kept, lambda x: entries_of(members, x["root_i"]))}).drop("_members")
        # names are used several times
        steps = computed(steps, {"_names": F.transform(kept, lambda x, n: _names(x, F.get("_mine", n), t, F.col("_compounds")))})
        made["entities"] = F.transform(kept, lambda x, n: _entity(x, F.get("_mine", n), F.get("_names", n), t, F.col("_compounds"), conjuncts, scene))
    if relations:
        made["relations"] = _located(found, conjuncts, where)
    graph = computed(steps, made).drop("_conjuncts", "_mine", "_names", "_compounds", "_found", "_kept", "_where", "_verbs", "_preps", "_scenes")
    return graph if keep_tokens else graph.drop(tokens, chunks)


def _spans(kept: Column) -> Column:
    return F.transform(kept, lambda c, n: F.struct(n.alias("entity_id"), c["start"].alias("start"), c["end"].alias("end")))


def entity_table(graphs: DataFrame, *keys: str) -> DataFrame:
    """One row per entity; ``entity_id`` is its index in the document's entity list."""
    return listed(graphs, keys, "entities", "entity_id")


def relation_table(graphs: DataFrame, *keys: str) -> DataFrame:
    """One row per relation; the ends are entity indexes."""
    return listed(graphs, keys, "relations", "relation_id")


def entity_view(graphs: DataFrame, *keys: str) -> DataFrame:
    """Entities as a lower-cased text table for reading."""
    return entity_table(graphs, *keys).select(
        *keys,
        "entity_id",
        F.lower("head").alias("head"),
        F.lower("span").alias("span"),
        # lowered once joined: a comma ends every context that a letter's case depends on
        F.lower(F.array_join(F.col("modifiers.span"), ",")).alias("modifiers"),
    )


def graph_view(graphs: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Two lower-cased text tables for reading: entities and relations."""
    entities = entity_view(graphs, *keys)
    named = named_relations(F.col("entities"), F.col("relations"))
    relations = listed(graphs, keys, named, "relation_id")
    return entities, relations


def named_relations(entities: Column, relations: Column) -> Column:
    """Relations with lower-cased entity heads instead of entity indexes."""
    return F.transform(
        relations,
        lambda r: F.struct(
            F.lower(F.get(entities, r["subject"])["head"]).alias("subject"),
            F.lower(r["relation"]).alias("relation"),
            F.lower(F.get(entities, r["object"])["head"]).alias("object"),
        ),
    )

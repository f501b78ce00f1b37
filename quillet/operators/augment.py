"""Augmented copies of texts. Chance is a digest of the row's id and a salt, so a run repeats itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text as T

#: Words and what may stand for them.
SYNONYMS = {
    "good": ["great", "excellent", "fine", "nice", "wonderful"],
    "bad": ["poor", "terrible", "awful", "horrible", "dreadful"],
    "big": ["large", "huge", "enormous", "massive", "giant"],
    "small": ["tiny", "little", "mini", "compact", "minute"],
    "fast": ["quick", "rapid", "swift", "speedy", "hasty"],
    "slow": ["sluggish", "leisurely", "gradual", "unhurried"],
    "happy": ["joyful", "cheerful", "glad", "delighted", "pleased"],
    "sad": ["unhappy", "sorrowful", "gloomy", "melancholy", "dejected"],
    "easy": ["simple", "straightforward", "effortless", "uncomplicated"],
    "hard": ["difficult", "challenging", "tough", "demanding", "complex"],
    "new": ["fresh", "novel", "recent", "modern", "latest"],
    "old": ["ancient", "aged", "elderly", "vintage", "antique"],
    "important": ["significant", "crucial", "vital", "essential", "critical"],
    "help": ["assist", "aid", "support", "facilitate", "contribute"],
    "make": ["create", "produce", "build", "construct", "generate"],
    "get": ["obtain", "acquire", "receive", "gain", "secure"],
    "use": ["utilize", "employ", "apply", "implement", "leverage"],
    "say": ["state", "mention", "express", "declare", "articulate"],
    "think": ["believe", "consider", "suppose", "assume", "reckon"],
    "want": ["desire", "wish", "need", "require", "seek"],
    "show": ["display", "demonstrate", "exhibit", "reveal", "present"],
    "give": ["provide", "offer", "supply", "deliver", "grant"],
    "take": ["grab", "seize", "capture", "acquire", "obtain"],
    "find": ["discover", "locate", "identify", "detect", "uncover"],
    "know": ["understand", "comprehend", "recognize", "realize", "grasp"],
    "work": ["function", "operate", "perform", "execute", "run"],
    "start": ["begin", "commence", "initiate", "launch", "kickoff"],
    "end": ["finish", "conclude", "complete", "terminate", "cease"],
    "look": ["appear", "seem", "view", "observe", "examine"],
    "ask": ["inquire", "question", "request", "query", "demand"],
}

#: Patterns of a paraphrase in lower-cased text, and what replaces their first match.
PARAPHRASES = [
    (r"what is (\w+)", r"can you explain \1"),
    (r"how do i (\w+)", r"what's the way to \1"),
    (r"can you (\w+)", r"could you \1"),
    (r"will you (\w+)", r"would you \1"),
    (r"i think (\w+)", r"in my opinion \1"),
    (r"i believe (\w+)", r"i feel \1"),
    (r"this is (\w+)", r"this seems \1"),
    (r" but ", " however "),
    (r" and ", " as well as "),
    (r" so ", " therefore "),
    (r" because ", " since "),
]

#: Phrases and what may stand for them; of a text the first of these that it holds.
PHRASES = {
    "very good": ["excellent", "outstanding", "superb"],
    "very bad": ["terrible", "awful", "horrible"],
    "very big": ["enormous", "huge", "massive"],
    "very small": ["tiny", "minuscule", "microscopic"],
    "a lot of": ["many", "numerous", "plenty of"],
    "kind of": ["somewhat", "rather", "sort of"],
}

_MARKS = ".,!?;:"


def chance(id_: Column, salt, of: Column | int) -> Column:
    """A number from 0 to ``of`` - 1 that the row's id and the salt decide."""
    return F.pmod(F.conv(_digits(id_, salt), 16, 10).cast("long"), of if isinstance(of, Column) else F.lit(of))


def _digits(id_: Column, salt) -> Column:
    """The eight digits that :func:`chance` reads; they sort as its numbers below 2**32 do."""
    salt = salt.cast("string") if isinstance(salt, Column) else F.lit(str(salt))
    return F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit("|"), salt).cast("binary")), 1, 8)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), "")


def _drawn(places: Column, id_: Column, salt: str, n: Column) -> Column:
    """``n`` of an array of places, drawn without replacement. ``sort_array`` compares rows by itself, ``array_sort`` by an expression."""
    keyed = F.sort_array(F.transform(places, lambda i: F.struct(_digits(id_, F.concat(F.lit(f"{salt}:"), i.cast("string"))).alias("r"), i.alias("i"))))
    return F.transform(F.slice(keyed, F.lit(1), n), lambda x: x["i"])


def _places(words: Column) -> Column:
    return F.transform(words, lambda w, i: i)


def synonyms(text: Column, id_: Column, ratio: float = 0.3) -> Column:
    """Some words replaced by synonyms, their first capital and closing marks kept; a text without any word of
    the lexicon stays as it is."""
    lexicon = F.create_map(*(x for word, options in SYNONYMS.items() for x in (F.lit(word), F.array(*map(F.lit, options)))))
    plain = lambda w: F.btrim(F.lower(w), F.lit(_MARKS))

    def replaced(words: Column) -> Column:
        known = F.filter(F.transform(words, lambda w, i: F.when(F.map_contains_key(lexicon, plain(w)), i)), lambda i: i.isNotNull())
        n = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int"))

        def word(chosen: Column):
            def of(w: Column, i: Column) -> Column:
                options = F.element_at(lexicon, plain(w))
                new = F.get(options, chance(id_, F.concat(F.lit("synonym:"), i.cast("string")), F.size(options)).cast("int"))
                new = F.when(F.substring(w, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new)))).otherwise(new)
                return F.when(F.array_contains(chosen, i), F.concat(new, F.regexp_extract(w, r"[.,!?;:]*$", 0))).otherwise(w)

            return of

        return T.let(_drawn(known, id_, "place", n), lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(words, word(c)), " ")))

    return F.coalesce(T.let(_words(text), replaced), text)


def deleted(text: Column, id_: Column, ratio: float = 0.1) -> Column:
    """Some words left out; texts of under three words stay."""

    def cut(words: Column) -> Column:
        keep = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(1 - ratio)).cast("int"))
        kept = T.let(F.sort_array(_drawn(_places(words), id_, "delete", keep)), lambda k: F.array_join(F.transform(k, lambda i: F.get(words, i)), " "))
        return F.when(F.size(words) >= 3, kept)

    return F.coalesce(T.let(_words(text), cut), text)


def inserted(text: Column, id_: Column, ratio: float = 0.1) -> Column:
    """Some words of the text put in once more after some of its places; texts of under three words stay."""

    def more(words: Column) -> Column:
        n = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int"))
        extra = F.transform(
            F.sequence(F.lit(1), n),
            lambda j: F.struct(chance(id_, F.concat(F.lit("at:"), j.cast("string")), F.size(words)).alias("i"), j.alias("j"), F.get(words, chance(id_, F.concat(F.lit("word:"), j.cast("string")), F.size(words)).cast("int")).alias("w")),
        )
        own = F.transform(words, lambda w, i: F.struct(i.cast("long").alias("i"), F.lit(0).alias("j"), w.alias("w")))
        return F.when(F.size(words) >= 3, F.array_join(F.transform(F.sort_array(F.concat(own, extra)), lambda x: x["w"]), " "))

    return F.coalesce(T.let(_words(text), more), text)


def swapped(text: Column, id_: Column, ratio: float = 0.1) -> Column:
    """Some pairs of words exchanged, each word at most once; texts of under three words stay."""

    def turn(words: Column) -> Column:
        n = 2 * F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int"))
        order = _drawn(_places(words), id_, "swap", F.size(words))

        def moved(o: Column) -> Column:
            to = F.transform(o, lambda i, r: F.struct(F.when(r < n, F.get(o, r.bitwiseXOR(F.lit(1)))).otherwise(i).alias("to"), F.get(words, i).alias("w")))
            return F.array_join(F.transform(F.sort_array(to), lambda x: x["w"]), " ")

        return F.when(F.size(words) >= 3, T.let(order, moved))

    return F.coalesce(T.let(_words(text), turn), text)


def paraphrased(text: Column, id_: Column, share: float = 0.5) -> Column:
    """Some of the patterns tried, each with even chance, on the lower-cased text; a first capital comes back. A
    text that none changes stays as it is."""
    n = max(1, int(len(PARAPHRASES) * share))
    chosen = _drawn(F.array(*map(F.lit, range(len(PARAPHRASES)))), id_, "pattern", F.lit(n))

    def tried(i: int, pattern: str, new: str):
        use = F.array_contains(chosen, i) & (chance(id_, f"try:{i}", 2) == 0)
        first = "$1" + new.replace(r"\1", "$2")
        return lambda t: F.when(use, F.regexp_replace(t, rf"(?s)\A(.*?){pattern}", first)).otherwise(t)

    out = F.lower(text)
    for i, (pattern, new) in enumerate(PARAPHRASES):
        out = T.let(out, tried(i, pattern, new))
    capital = F.substring(text, 1, 1).rlike(r"\p{Lu}")
    upper = lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    return T.let(out, lambda t: F.when(t == F.lower(text), text).when(capital, upper(t)).otherwise(t))


def translated_back(text: Column, id_: Column, rate: int = 30) -> Column:
    """Words with traces of a translation: of ``rate`` in a hundred words one third each stays, loses its
    apostrophes for blanks, or has a closing "ing" made "e"."""

    def trace(w: Column, i: Column) -> Column:
        how = chance(id_, F.concat(F.lit("how:"), i.cast("string")), 3)
        hit = chance(id_, F.concat(F.lit("hit:"), i.cast("string")), 100) < rate
        return F.when(hit & (how == 1), F.replace(w, F.lit("'"), F.lit(" "))).when(hit & (how == 2), F.regexp_replace(w, "ing$", "e")).otherwise(w)

    return F.array_join(F.transform(_words(text), trace), " ")


def rephrased(text: Column, id_: Column) -> Column:
    """The first phrase of the list that the text holds replaced, where it first stands."""
    out = text
    for phrase, options in reversed(PHRASES.items()):
        new = F.get(F.array(*map(F.lit, options)), chance(id_, f"phrase:{phrase}", len(options)).cast("int"))
        at = F.instr(F.lower(text), phrase)
        changed = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + len(phrase), F.length(text)))
        out = F.when(at > 0, changed).otherwise(out)
    return out


TECHNIQUES = {"synonym": synonyms, "delete": deleted, "insert": inserted, "swap": swapped, "paraphrase": paraphrased, "back_translation": translated_back, "contextual": rephrased}


def augmented(rows: DataFrame, text: str = "text", id_field: str = "doc_id", copies: int = 1, techniques: list[str] | None = None) -> DataFrame:
    """The rows, and for each up to ``copies`` with another text, made by a technique drawn for it. Adds
    augmented, technique and original_id; a copy whose text is empty or the same is left out."""
    names = techniques or list(TECHNIQUES)
    drawn = rows.withColumn("copy__", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    seed = F.concat(F.coalesce(F.col(id_field).cast("string"), F.lit("")), F.lit("#"), F.col("copy__").cast("string"))
    which = F.get(F.array(*map(F.lit, names)), chance(seed, "technique", len(names)).cast("int"))
    drawn = drawn.withColumn("technique", F.when(F.col("copy__") > 0, which))
    new = F.coalesce(*(F.when(F.col("technique") == n, TECHNIQUES[n](F.col(text), seed)) for n in names))
    drawn = drawn.withColumn("new__", F.when(F.col("copy__") > 0, new))
    kept = drawn.where((F.col("copy__") == 0) | ((F.coalesce("new__", F.lit("")) != "") & ~F.col("new__").eqNullSafe(F.col(text))))
    out = kept.withColumns({text: F.coalesce("new__", text), "augmented": F.col("copy__") > 0, "original_id": F.when(F.col("copy__") > 0, F.col(id_field))})
    return out.drop("copy__", "new__")


def augmented_totals(rows: DataFrame) -> DataFrame:
    """One row a technique: copies, and their share of all copies in percent."""
    copies = rows.where("augmented").groupBy("technique").agg(F.count("*").alias("n"))
    total = copies.agg(F.sum("n").alias("total"))  # one row
    return copies.join(F.broadcast(total)).select("technique", "n", F.round(100 * F.col("n") / F.col("total"), 1).alias("percent"))

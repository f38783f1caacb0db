"""Line-first quality cleaning: judge every line, drop failures, reject documents that lose too much.

DataFrame functions only. Nothing is shuffled: each document is judged from its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import WHITE_CLASS, fresh, let

WORDLESS = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Runs of symbols or of exclamation and question marks; separators that stand alone; words in capitals.
MARKS = r"[#*$%&<>~^=_]+|!{2,}|\?{2,}"
SEPARATORS = r"(^|[\x20\x09-\x0D])[|>»•·]([\x20\x09-\x0D]|$)"
BARS = r"[|>»•·]"
SHOUTS = r"(^|[\x20\x09-\x0D])\p{Lu}{2,}"
#: Ends of sentences and clauses, closing quotes and brackets included; links.
ENDING = r"[.!?:;…。！？：；؟।][“\"\x27”’»)\]}]*([\x20\x09-\x0D]|$)"
LINKS = r"(^|[\x20\x09-\x0D(<])(https?://|www\.|mailto:)[^\x20\x09-\x0D]"
#: Marks of page furniture in any language: copyright lines, templates, markup.
FURNITURE = r"[©({<](?:[cC]\) ?(19|20)[0-9]{2}|\{|/?[a-zA-Z][a-zA-Z0-9]*( [^<>]*)?/?>| ?(19|20)[0-9]{2})"
#: Phrases that mark a line as page furniture, in English, German, French and Spanish; at a word's start.
BOILERPLATE = (
    r"(?i)(^|[\x20\x09-\x0D(\"])(javascript|cookie (policy|settings|notice|banner)|accept (all )?cookies|uses cookies|cookie-richtlinie|verwendet cookies|cookies (akzeptieren|zulassen)|utilise des cookies|usa cookies|aceptar cookies"
    r"|privacy policy|datenschutzerkl|politique de confidentialit|pol.tica de privacidad|terms of (use|service)|nutzungsbedingungen|conditions d.utilisation|condiciones de uso|t.rminos de servicio"
    r"|all rights reserved|alle rechte vorbehalten|tous droits r.serv|todos los derechos reservados|click here|hier klicken|cliquez ici|haga clic aqu|clic aqu"
    r"|sign up for our newsletter|subscribe to our|newsletter abonnieren|abonnez-vous|suscr.bete|lorem ipsum|skip to (main )?content|zum inhalt springen|aller au contenu|saltar al contenido"
    r"|back to top|nach oben scrollen|haut de page|volver arriba|(share (this )?on|teilen auf|partager sur|compartir en) (facebook|twitter|whatsapp))"
)


def words_of(text: Column) -> Column:
    """The words of ``text``: runs outside the white space class; null and blank text have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+"), "")


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many word positions lie in a ``window``-word run that occurs twice or more in ``words``."""
    n = F.size(words)

    def detail(grams: Column) -> Column:
        ordered = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(o: Column) -> Column:
            last = F.size(o)
            hash_at = lambda k: F.get(o, k).getField("h")
            twice = F.filter(
                F.transform(o, lambda x, k: F.when(
                    ((k > 0) & (hash_at(k - 1) == x["h"])) | ((k < last - 1) & (hash_at(k + 1) == x["h"])), x["i"])),
                lambda p: p.isNotNull())
            return let(F.array_sort(twice), lambda at: F.aggregate(
                F.transform(at, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1), p + window) - p)),
                F.lit(0).cast("long"), lambda total, x: total + x))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(ordered, covered))

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(window))))

    return F.when(n < window, F.lit(0).cast("long")).otherwise(let(grams(words), detail))


def line_passes(line: Column, max_symbol_ratio: float, max_shout_ratio: float, max_boilerplate_chars: int, min_sentence_words: int) -> Column:
    """Whether a line is content. Blank lines pass (they carry nothing to lose).

    Punctuation: at most ``max_symbol_ratio`` symbol or exclamation runs a word; in a line of ``min_sentence_words``
    words or more, a sentence or clause ends at least once in 100 words. Navigation: menus, that is at least three separators (``|`` ``>`` and the like)
    making up a fifth of the words, or links making up half of them. Boilerplate: a line of at most
    ``max_boilerplate_chars`` code points with a mark of ``FURNITURE``, whatever its language, or with one of the phrases
    in ``BOILERPLATE``; longer lines may speak of such things. Shouting: most words are in capitals in a long line. Ratios are not negative. A blank line fails no rule.
    """
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    has = lambda pattern: F.rlike(line, F.lit(pattern))

    # Inside a lambda nothing shares equal expressions, and counting words costs most: each rule first asks for what it
    # cannot fail without. A line of n code points has (n + 1) / 2 words at most, so that many sentence ends settle it.
    words = lambda rule: let(count(f"{WORDLESS}+"), rule)
    chars = F.length(line)
    endless = (chars >= 2 * min_sentence_words - 1) & let(
        count(ENDING), lambda ends: (ends * 200 < chars + 1) & words(lambda n: (n >= min_sentence_words) & (ends * 100 < n)))
    symbols = has(MARKS) & words(lambda n: (n >= 4) & (count(MARKS) > max_symbol_ratio * n))
    menu = has(BARS) & let(count(SEPARATORS), lambda menus: (menus >= 3) & words(lambda n: menus * 5 >= n))
    furniture = (chars <= max_boilerplate_chars) & (has(FURNITURE) | has(BOILERPLATE))
    linked = (F.contains(line, F.lit("://")) | F.contains(line, F.lit("www.")) | F.contains(line, F.lit("mailto:"))) & let(
        count(LINKS), lambda links: (links > 0) & words(lambda n: links * 2 >= n))
    shouted = has(SHOUTS) & words(lambda n: (n >= 8) & (count(SHOUTS) > max_shout_ratio * n))
    return ~(endless | symbols | menu | furniture | linked | shouted)


def verdict_of(text: Column, max_loss: float = 0.5, max_symbol_ratio: float = 0.3, max_shout_ratio: float = 0.5, max_boilerplate_chars: int = 200,
               min_sentence_words: int = 8) -> Column:
    """The struct that ``judge`` adds, for one text. The parameters besides ``max_loss`` are those of ``line_passes``."""
    text = F.coalesce(text, F.lit(""))
    lines = F.split(text, "\n", -1)

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def line_counts(rows: Column) -> Column:
        return let(F.filter(rows, lambda x: F.rlike(x, F.lit(WORDLESS))), lambda full: let(
            F.filter(rows, lambda x: line_passes(x, max_symbol_ratio, max_shout_ratio, max_boilerplate_chars, min_sentence_words)), lambda good: F.struct(
                F.size(rows).cast("long").alias("n_lines"),
                (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
                (F.size(rows) - F.size(good)).cast("long").alias("n_failed_lines"),
                F.length(F.array_join(full, "")).cast("long").alias("chars"),
                F.length(F.array_join(F.filter(good, lambda x: F.rlike(x, F.lit(WORDLESS))), "")).cast("long").alias("good_chars"),
                F.array_join(good, "\n").alias("cleaned"))))

    def verdict(c: Column) -> Column:
        def with_lines(x: Column) -> Column:
            failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
            lost = F.when(x["chars"] > 0, 1 - x["good_chars"] / x["chars"]).otherwise(F.lit(0.0))
            return F.struct(
                c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                x["n_dup_lines"].alias("n_dup_lines"), c["n_repeat_words"].alias("n_repeat_words"),
                failed.alias("base_failed"), (~failed & (lost <= max_loss)).alias("kept"), lost.alias("lost_ratio"),
                x["n_lines"].alias("n_lines"), x["n_failed_lines"].alias("n_failed_lines"), x["cleaned"].alias("cleaned"))
        return let(let(lines, line_counts), with_lines)

    return let(let(words_of(text), counts), verdict)


def judge(docs: DataFrame, out: str = "quality", **rules: float) -> DataFrame:
    """Add ``out``, a struct of counts, the cleaned text and the verdict, to each row of ``docs``.

    ``quality`` has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), lost_ratio (double: share of non-blank characters on failing lines), n_lines, n_failed_lines
    (long) and cleaned (text: the passing lines joined by a newline). Base rules: fewer than 10 words, or
    over 20 % of the words in repeated five-word runs. ``kept`` is false if the base rules fail or lines
    holding more than ``max_loss`` of the characters fail. ``rules``: the parameters of ``verdict_of``.

    Null text counts as empty: 0 words, base_failed, not kept, cleaned ''. Repeated rows are judged alike,
    one by one. Other columns, one named ``out`` excepted (it is replaced), pass through; an empty table stays
    empty.
    """
    return docs.withColumn(out, verdict_of(F.col("text"), **rules))


def clean(docs: DataFrame, **rules: float) -> DataFrame:
    """The documents that pass, with failing lines taken out of their text; columns as in ``docs``."""
    # Kept documents come out of a generator: a filter on the verdict would evaluate it again for the text.
    verdict = fresh(docs, "quality")
    passed = F.explode(F.filter(F.array(verdict_of(F.col("text"), **rules)), lambda q: q["kept"]))
    return docs.select("*", passed.alias(verdict)).withColumn("text", F.col(verdict)["cleaned"]).drop(verdict)

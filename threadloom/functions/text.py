"""Text functions as columns: cleaners, token features, lexical diversity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Emoji ranges of the analysis (the last one also covers CJK and other blocks).
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
#: ASCII punctuation.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
URLS = r"http\S+|www\.\S+|www\S+|https\S+"
#: Pronouns that the pronoun ratio compares.
FIRST_PERSON = ("i", "me", "my", "mine", "myself")
WE_AND_YOU = ("we", "us", "our", "ours", "you", "your", "yours")
#: Entities that cleaning decodes, in this order.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'))
#: Tokens for which diversity measures are undefined.
LEAST_TOKENS = 5
MTLD_LIMIT = 0.72


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside functions of array elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sub(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, "(?U)" + pattern, by)


def _squeeze(text: Column) -> Column:
    return F.trim(_sub(text, r"\s+", " "))


def clean_text(text: Column, keep_emojis: bool = True, remove_urls: bool = True, lowercase: bool = True) -> Column:
    """Posts without URLs, mentions and hash signs, entities decoded; null and blank are empty."""
    out = F.coalesce(text, F.lit(""))
    out = F.lower(out) if lowercase else out
    out = _sub(out, URLS) if remove_urls else out
    out = _sub(_sub(_sub(out, r"@\w+"), r"#(\w+)", "$1"), "#")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = _sub(out, r"&#\d+;")
    if not keep_emojis:
        out = F.regexp_replace(out, EMOJI, "")
    return _squeeze(out)


def clean_text_plain(text: Column) -> Column:
    """The variant for sentiment notebooks: lone hash signs stay, URLs need http or ``www.``."""
    out = _sub(F.lower(F.coalesce(text, F.lit(""))), r"http\S+|www\.\S+")
    out = _sub(_sub(out, r"@\w+"), r"#(\w+)", "$1")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return _squeeze(_sub(out, r"&#\d+;"))


def clean_stance_text(text: Column) -> Column:
    """The variant for stance: lower case, no URLs, mentions or hash signs."""
    out = _sub(F.lower(F.coalesce(text, F.lit(""))), URLS)
    return _squeeze(_sub(_sub(out, r"@\w+"), "#"))


def clean_tweet(text: Column) -> Column:
    """The variant for features: whole hashtags go, then all but word characters; lower case last."""
    out = _sub(F.coalesce(text, F.lit("")), r"http\S+|www\S+")
    out = _sub(_sub(_sub(out, r"@\w+"), r"#\w+"), r"[^\w\s]")
    return F.lower(_squeeze(out))


def tokenize(text: Column) -> Column:
    """Words and single other characters, as an array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def split_words(text: Column) -> Column:
    """White-space separated words; none for null or blank."""
    return F.filter(F.split(_squeeze(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")


def topic_tokens(text: Column, stop_words: Sequence[str], lemmas: dict[str, str] | None = None, tokenizer: Callable[[Column], Column] = split_words) -> Column:
    """Lower-cased tokens without ASCII punctuation and stop words, lemmatized by a map."""
    bare = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\p{Punct}", "")
    stop = F.array(*(F.lit(w) for w in stop_words)).cast("array<string>")
    out = F.filter(tokenizer(bare), lambda w: ~F.array_contains(stop, w) & (F.trim(w) != ""))
    if lemmas:
        table = F.create_map(*(F.lit(x) for pair in lemmas.items() for x in pair))
        out = F.transform(out, lambda w: F.coalesce(F.try_element_at(table, w), w))
    return out


def topic_text(tokens: Column, least: int = 7) -> Column:
    """Tokens joined by spaces, or empty if there are fewer than ``least``."""
    return F.when(F.size(tokens) < least, F.lit("")).otherwise(F.array_join(tokens, " "))


def _rate(count: Column, text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, count / n).otherwise(F.lit(0.0))


def emoji_rate(text: Column) -> Column:
    """Runs of emoji for each character; 0 for empty text."""
    text = F.coalesce(text, F.lit(""))
    return _rate(F.regexp_count(text, F.lit(EMOJI)), text)


def punctuation_rate(text: Column) -> Column:
    """ASCII punctuation for each character; 0 for empty text."""
    text = F.coalesce(text, F.lit(""))
    return _rate(F.regexp_count(text, F.lit(PUNCTUATION)), text)


def n_sentences(text: Column) -> Column:
    """Non-blank pieces between runs of ``.!?``."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: _squeeze(s) != ""))


def _among(tokens: Column, words: Sequence[str]) -> Column:
    return F.size(F.filter(tokens, lambda w: F.lower(w).isin(*words)))


def syllables(word: Column) -> Column:
    """Vowel groups of a word, at least one."""
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[aeiouy]+")), F.lit(1))


def reading_ease(text: Column) -> Column:
    """Flesch reading ease with vowel groups for syllables; 0 without words."""
    words = F.filter(tokenize(text), lambda w: w.rlike(r"(?U)^\w+$"))
    n = F.size(words)
    syl = F.aggregate(words, F.lit(0), lambda z, w: z + syllables(w))
    return F.when(n > 0, 206.835 - 1.015 * n / F.greatest(n_sentences(text), F.lit(1)) - 84.6 * syl / n).otherwise(F.lit(0.0))


def style_features(text: Column, tokenizer: Callable[[Column], Column] = tokenize, readability: Callable[[Column], Column] = reading_ease) -> dict[str, Column]:
    """pronoun_ratio, avg_sent_length, readability, exclamation_rate, ellipsis_rate; all 0 for blank text."""
    tokens = tokenizer(text)
    n = F.greatest(F.size(tokens), F.lit(1))
    blank = _squeeze(F.coalesce(text, F.lit(""))) == ""
    made = {
        "pronoun_ratio": _among(tokens, FIRST_PERSON) / (_among(tokens, WE_AND_YOU) + 1e-5),
        "avg_sent_length": n / F.greatest(n_sentences(text), F.lit(1)),
        "readability": readability(text),
        "exclamation_rate": F.regexp_count(text, F.lit("!")) / n,
        "ellipsis_rate": F.regexp_count(text, F.lit(r"\.\.\.")) / n,
    }
    return {k: F.when(blank, F.lit(0.0)).otherwise(v).alias(k) for k, v in made.items()}


def token_entropy(tokens: Column) -> Column:
    """Shannon entropy in bits; 0 for no tokens. Sorted tokens are counted run by run, so long texts take no square of their length."""
    n = F.size(tokens)
    term = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))

    def step(z: Column, w: Column) -> Column:
        same = z["word"].eqNullSafe(w)
        return F.struct(w.alias("word"), F.when(same, z["run"] + 1).otherwise(F.lit(1.0)).alias("run"), F.when(same, z["sum"]).otherwise(z["sum"] + term(z["run"])).alias("sum"))

    start = F.struct(F.lit(None).cast("string").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.array_sort(tokens), start, step, lambda z: z["sum"] + term(z["run"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(F.lit(0.0))


def _last_seen(tokens: Column) -> Column:
    """For each token the position of the same token before it, or -1: equal tokens are neighbours once sorted."""

    def seen(pairs: Column) -> Column:
        before = lambda p, k: F.when(F.get(pairs, k - 1)["w"] == p["w"], F.get(pairs, k - 1)["i"]).otherwise(F.lit(-1))
        return F.transform(F.array_sort(F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), before(p, k).alias("last")))), lambda x: x["last"])

    return let(F.array_sort(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), seen)


def _mtld_factors(tokens: Column, limit: float) -> Column:
    """Factors of one direction: full ones, and the part of the last. A token is new if it was last seen before its factor's start."""

    def step(z: Column, last: Column) -> Column:
        def moved(types: Column) -> Column:
            full = types / (z["at"] - z["start"] + 1) <= limit
            return F.struct(F.when(full, z["factors"] + 1).otherwise(z["factors"]).alias("factors"), F.when(full, F.lit(0)).otherwise(types).alias("types"), F.when(full, z["at"] + 1).otherwise(z["start"]).alias("start"), (z["at"] + 1).alias("at"))

        return let(F.when(last < z["start"], z["types"] + 1).otherwise(z["types"]), moved)

    begin = F.struct(F.lit(0.0).alias("factors"), F.lit(0).alias("types"), F.lit(0).alias("start"), F.lit(0).alias("at"))
    rest = lambda z: F.when(z["at"] > z["start"], (1 - z["types"] / (z["at"] - z["start"])) / (1 - limit)).otherwise(0.0)
    return F.aggregate(_last_seen(tokens), begin, step, lambda z: z["factors"] + rest(z))


def mtld(tokens: Column, limit: float = MTLD_LIMIT) -> Column:
    """Measure of textual lexical diversity, mean of both directions; 0 below two tokens or without factors."""
    n = F.size(tokens)

    def one(x: Column) -> Column:
        return let(_mtld_factors(x, limit), lambda f: F.when(f > 0, n / f).otherwise(F.lit(0.0)))

    return F.when(n < 2, F.lit(0.0)).otherwise((one(tokens) + one(F.reverse(tokens))) / 2)


def lexical_features(tokens: Column, least: int = LEAST_TOKENS) -> dict[str, Column]:
    """mtld, entropy (null below ``least`` tokens) and token_count."""
    enough = F.size(tokens) >= least
    return {"mtld": F.when(enough, mtld(tokens)).alias("mtld"), "entropy": F.when(enough, token_entropy(tokens)).alias("entropy"), "token_count": F.size(tokens).alias("token_count")}


def hashtags(text: Column) -> Column:
    """Hashtags with their sign, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)(#\w+)"), F.lit(1))


def preview(text: Column, n: int = 90) -> Column:
    """The first characters and an ellipsis."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def cluster_name(cluster: Column, words: Column) -> Column:
    """``Noise`` for -1, else the number and its words."""
    return F.when(cluster == -1, F.lit("Noise")).otherwise(F.concat(F.lit("Cluster "), cluster.cast("string"), F.lit(": "), F.array_join(words, ", ")))

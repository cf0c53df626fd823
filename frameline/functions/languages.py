"""Language codes and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codes with their names, then further names of some codes.
NAMES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean", "fr": "french", "ja": "japanese",
    "pt": "portuguese", "tr": "turkish", "pl": "polish", "ca": "catalan", "nl": "dutch", "ar": "arabic", "sv": "swedish", "it": "italian",
    "id": "indonesian", "hi": "hindi", "fi": "finnish", "vi": "vietnamese", "iw": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay",
    "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian", "th": "thai", "ur": "urdu",
    "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin", "mi": "maori", "ml": "malayalam", "cy": "welsh", "sk": "slovak",
    "te": "telugu", "fa": "persian", "lv": "latvian", "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada",
    "et": "estonian", "mk": "macedonian", "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali", "mn": "mongolian",
    "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili", "gl": "galician", "mr": "marathi", "pa": "punjabi", "si": "sinhala",
    "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali", "af": "afrikaans", "oc": "occitan", "ka": "georgian", "be": "belarusian",
    "tg": "tajik", "sd": "sindhi", "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese", "sa": "sanskrit", "lb": "luxembourgish", "my": "myanmar",
    "bo": "tibetan", "tl": "tagalog", "mg": "malagasy", "as": "assamese", "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa",
    "ba": "bashkir", "jw": "javanese", "su": "sundanese",
}
ALIASES = {"burmese": "my", "valencian": "ca", "flemish": "nl", "haitian": "ht", "letzeburgesch": "lb", "pushto": "ps", "panjabi": "pa", "moldavian": "ro", "moldovan": "ro", "sinhalese": "si", "castilian": "es"}


def table(spark: SparkSession) -> DataFrame:
    """(code, name), further names too."""
    rows = [*NAMES.items(), *((code, name) for name, code in ALIASES.items())]
    return spark.createDataFrame(rows, "code string, name string")


def with_code(df: DataFrame, language: str, out: str = "code") -> DataFrame:
    """The code of a language given by code or name, in any case; an error for a language that is not known, null for null."""
    known = table(df.sparkSession)
    keys = known.select(F.col("name").alias("__k"), F.col("code").alias("__c")).unionByName(known.select(F.col("code").alias("__k"), F.col("code").alias("__c")).distinct())
    met = df.withColumn("__l", F.lower(language)).join(F.broadcast(keys), F.col("__l") == F.col("__k"), "left")
    wrong = F.raise_error(F.concat(F.lit("unsupported language: "), F.col("__l"))).cast("string")
    return met.withColumn(out, F.when(F.col("__l").isNull() | F.col("__c").isNotNull(), F.col("__c")).otherwise(wrong)).drop("__l", "__k", "__c")


def name_of(code: Column) -> Column:
    """The name of a code; null for others.  A table of fixed size."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair]), code)

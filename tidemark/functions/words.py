"""Word lists and small tables that results depend on. Kept as text, in one place."""

from __future__ import annotations

#: Words that witness nothing, in notes and in speech.
STOPWORDS = """
the a an and or but if then than that this these those of to in on for with as at by
from into over under about after before between during is are was were be been being it
its he she they them his her their you your we our me my not no so such one two three
four five six seven eight nine ten first second third what which who whom when where why
how all any both each few more most other some only own same too very can will just
should now also has have had do does did done get got make made say says said like out
up down off again further here there once because while against above below
""".split()

#: Capitalised words that name no one.
UNNAMING = """
the this that these those there then than when what where which while why how and but for with without from into onto
over under after before because since you your yours they them their his her hers its one two three four five six seven
eight nine ten not nothing none every each any all both same other another such only just still even also here now once
again most more less least much many few own out off up down left right first second third last next new old good bad big
small long short claims falsifier usable speculation run notes action inferred spoken screen orphan video note frame
eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty
ninety hundred thousand million
""".split()

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}

#: Signs that read as a colon.
COLONS = "ःઃ։܃܄᛬︰᠃᠉⁚׃˸꞉∶ːꓽ\U00011dd9"

#: What a speaker says who points at the screen; the choices of one pattern.
POINTING = [
    r"(?:let'?s |now |so |if you )?(?:take a |have a )?look at (?:this|that|these|those|the|my|our|your|his|her|its|their|another|a|an|it|here)\b",
    r"look (?:here|at the screen)\b",
    r"as you can see|you(?:'ll| will| can)? see (?:here|this|that|the)\b",
    r"(?:we|i) (?:can )?see (?:here|this|that|the)\b",
    r"notice (?:this|that|these|those|the|my|our|your|his|her|its|their|another|a|an|it|here)\b|notice how\b",
    r"watch (?:what happens|this|closely)\b",
    r"(?:right |over )?here (?:you|we|is|are|i)\b",
    r"(?:shown|show(?:n|ing)?) (?:here|on (?:the )?(?:screen|slide))\b",
    r"(?:this|the) (?:slide|chart|graph|diagram|screenshot|table|screen)\b",
    r"on (?:this|the) (?:screen|slide|message|page|tab)\b",
    r"(?:if you )?zoom in\b",
]

#: Number words that state how many, and their values.
COUNTS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "both": 2}

#: Language codes and names that a decoder answers with.
LANGUAGES = {
    "en": "english", "zh": "chinese", "de": "german", "es": "spanish", "ru": "russian", "ko": "korean",
    "fr": "french", "ja": "japanese", "pt": "portuguese", "tr": "turkish", "pl": "polish", "ca": "catalan",
    "nl": "dutch", "ar": "arabic", "sv": "swedish", "it": "italian", "id": "indonesian", "hi": "hindi",
    "fi": "finnish", "vi": "vietnamese", "he": "hebrew", "uk": "ukrainian", "el": "greek", "ms": "malay",
    "cs": "czech", "ro": "romanian", "da": "danish", "hu": "hungarian", "ta": "tamil", "no": "norwegian",
    "th": "thai", "ur": "urdu", "hr": "croatian", "bg": "bulgarian", "lt": "lithuanian", "la": "latin", "mi": "maori",
    "ml": "malayalam", "cy": "welsh", "sk": "slovak", "te": "telugu", "fa": "persian", "lv": "latvian",
    "bn": "bengali", "sr": "serbian", "az": "azerbaijani", "sl": "slovenian", "kn": "kannada", "et": "estonian",
    "mk": "macedonian", "br": "breton", "eu": "basque", "is": "icelandic", "hy": "armenian", "ne": "nepali",
    "mn": "mongolian", "bs": "bosnian", "kk": "kazakh", "sq": "albanian", "sw": "swahili", "gl": "galician",
    "mr": "marathi", "pa": "punjabi", "si": "sinhala", "km": "khmer", "sn": "shona", "yo": "yoruba", "so": "somali",
    "af": "afrikaans", "oc": "occitan", "ka": "georgian", "be": "belarusian", "tg": "tajik", "sd": "sindhi",
    "gu": "gujarati", "am": "amharic", "yi": "yiddish", "lo": "lao", "uz": "uzbek", "fo": "faroese",
    "ht": "haitian creole", "ps": "pashto", "tk": "turkmen", "nn": "nynorsk", "mt": "maltese", "sa": "sanskrit",
    "lb": "luxembourgish", "my": "myanmar", "bo": "tibetan", "tl": "tagalog", "mg": "malagasy", "as": "assamese",
    "tt": "tatar", "haw": "hawaiian", "ln": "lingala", "ha": "hausa", "ba": "bashkir", "jw": "javanese",
    "su": "sundanese", "yue": "cantonese",
}

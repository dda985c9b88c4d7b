"""Word lists, stems and affixes of Central Kurdish morphology, as plain constants."""

from __future__ import annotations

# Closed classes.
SUBJECT_PRONOUNS = {"من": ("1", "sg"), "تۆ": ("2", "sg"), "ئەو": ("3", "sg"), "ئێمە": ("1", "pl"), "ئێوە": ("2", "pl"), "ئەوان": ("3", "pl")}
REFLEXIVE, REFLEXIVES = "خۆ", ("خۆم", "خۆت", "خۆی", "خۆمان", "خۆتان", "خۆیان")
INTERROGATIVES, RECIPROCALS = ("کێ", "چی", "چ", "کام"), ("یەکتر", "یەکدی", "ئێکدی", "ئێکتر")
DEMONSTRATIVES = ("ئەو", "ئەم", "ئەوە", "ئەمە")
PREPOSITIONS = (
    "لە بە بۆ بێ تا هەتا تاکو تاوەکو هەتاوەکو لەگەڵ لەتەک پێش پاش تەنیشت بەرامبەر نێوان سەرەوە ژێرەوە لای بەبێ لەبۆ بەدرێژایی بەرەو لەبەر لەپێش لەپاش لەژێر لەسەر لەتەنیشت لەبەرامبەر لەنێوان".split() + ["لە لایەن"]
)
COORDINATING = "و بەڵام یا ئەوسا ئەوجا بەڵکوو وەکوو ئینجا ئەگینا وە".split()
SUBORDINATING = "کە بۆئەوەی کەچی هەتاکوو چونکە ئەگەر گەر مەگەر ئەگەرچی بۆیە".split() + ["لەبەرئەوەی کە"]
PARTICLES = "ئایا ئەرێ خۆزگە خۆزیا بریا کاشکی ئەی هۆ هێ یا ۆ دەبێت ئەبێت با".split()
NUMERALS = "یەک دوو سێ چوار پێنج شەش حەوت هەشت نۆ دە یازدە دوازدە سێزدە چواردە پازدە شازدە حەڤدە هەژدە نۆزدە بیست سی چل پەنجا شەست حەفتا هەشتا نەوەد سەد هەزار ملیۆن".split()
QUANTIFIERS = (
    "هەموو گشت هەندێک چەند تۆزێک هیچ زۆر کەم فرە یەکێک دوو سێ چوار پێنج شەش حەوت هەشت نۆ دە یازدە دوازدە سێزدە چواردە پازدە شازدە حەڤدە هەژدە نۆزدە بیست سی چل پەنجا شەست حەفتا هەشتا نەوەد سەد هەزار چەندین چەندێک هەرچەند"
).split()
ADVERBS = (
    "زوو دوا دواتر بەخێرایی بەهێواشی بەتەنیا بەیەکەوە قەت ئێستا دوێنێ سبەی بەیانی ئەمڕۆ ئەمشەو هەمیشە بەردەوام هەرگیز پێشتر دوایی دوایین بەرێ زووتر لێرە ئەوێ لەدەرەوە لەناوەوە لەسەرەوە لەژێرەوە لەپێشەوە "
    "لەپاشەوە تەواو تەنیا هەر زۆرتر کەمتر هەرچەندە بەراستی هیچکات بێگومان دلنیایی"
).split()
QUESTION_ADVERBS = "کوا چۆن کەی چەند بۆچی بۆ".split()
ADJECTIVES = (
    "گەورە بچووک باش خراپ نوێ کۆن جوان درێژ کورت گرنگ ئاسان سەخت تازە ڕەش سپی سوور زەرد شین خۆش بەرز نزم پان تەسک قووڵ فراوان تەنک ئەستوور سارد گەرم وشک تەڕ قورس سووک تاریک ڕووناک هێمن توند نەرم ڕەق پیر گەنج "
    "دەوڵەمەند هەژار زیرەک گێل لاواز بەهێز نوقم چەورەبن"
).split()
CONTRACTED = "بەم لەم بەو لەو بەمە لەمە بەمانە لەمانە بەوە لەوە بەوانە لەوانە".split()
FRACTIONS, HALF = ("نیو", "سێ‌یەک", "چوار‌یەک"), {"نیو": "abstract", "نیوە": "concrete"}
ORDINAL_ENDINGS = {"ەم": "short", "ەمین": "long", "ەمیین": ""}
ADVERB_PREFIX, SUPERLATIVE, COMPARATIVE, MOST = "بە", "ترین", "تر", "هەرە"
PUNCTUATION = r"!-/:-@\[-`{-~،؛؟ـ٪-٭۔\x{2000}-\x{206F}\x{2E00}-\x{2E7F}\x{3000}-\x{303F}"
DIGITS = "0-9٠-٩۰-۹"

# Slots of the verb.
NEGATIONS, PREVERBS, MOODS = ("نە", "نا", "مە"), ("وەر", "هەڵ", "دەر", "لێ", "تێ", "پێ"), ("دە", "ئە", "ب")
PASSIVE, CAUSATIVE, AGAIN = ("ڕا", "ڕێ"), ("اند", "ێن"), ("ەوە", "وە")
PRESENT_ENDINGS = ("یت", "ێت", "ین", "ەم", "ەن", "ات", "م", "ن", "ێ")
ENDINGS = {
    "مان": ("1", "pl"), "تان": ("2", "pl"), "یان": ("3", "pl"), "یت": ("2", "sg"), "ێت": ("3", "sg"), "ین": ("1", "pl"), "ەم": ("1", "sg"), "ەن": ("3", "pl"), "ات": ("3", "sg"),
    "م": ("1", "sg"), "ن": ("3", "pl"), "ێ": ("3", "sg"), "ت": ("2", "sg"),
}
PORTMANTEAU = ("ەتی", "یتی")
#: Roots by the ending of their past stem, in the order in which they are looked for.
PAST_ROOTS = {
    "ا": "سووت وەست شک کێڵ ترس گەڕ ڕژ پس خنک دڕ بڕ فەوت هەست هێن پێچ کوت هەڵکش سووڕ هەڵس پێو ڕووخ شەق ئاو کش خلیسک ڕاگیر نیز نەچ تەرخ شکاند پژم بز بزر".split(),
    "ی": "فڕ خز تەق نووس کڕ ناس تاش دۆز بەخش چن بین زان توان پەڕ پژم بز کۆک بزڕک گریا خوێند ژیا کەمتر گوێگرت".split(),
    "و": "بو چو درو ڕو لاچو".split(),
    "ت": "کوش گر نوس خەو گو بەس بیس فرۆش هاوش پش شوش ڕش گەیش ڕۆیش نیش دانیش پاراس ڕاکش دامەزر هەڵگر".split(),
    "د": "کر بر مر خوار نار سپار ژمار بژار شار خوێن هاوار ئاوار".split(),
}
PAST_TO_PRESENT = {
    "ڕۆیشت": "ڕۆ", "برد": "بە", "کرد": "کە", "خوارد": "خۆ", "دا": "دە", "شوشت": "شۆ", "هاوشت": "هاوێژ", "کوشت": "کوژ", "هێنا": "هێن", "گوت": "ڵێ", "دیت": "بین", "مرد": "مر", "گەیشت": "گە", "سپارد": "سپێر",
    "ژمارد": "ژمێر", "بژارد": "بژێر", "نارد": "نێر", "شارد": "شێر", "خست": "خ", "گرت": "گر", "بوو": "ب", "پاراست": "پار", "بەست": "بەست", "بیست": "بیست", "ویست": "وێ", "فرۆشت": "فرۆش", "کەوت": "کەو",
    "نووست": "نو", "خەوت": "خەو", "دۆزی": "دۆز",
}
SH_TO_ZH = ("کوژ", "بێژ", "ڕێژ", "هاوێژ")
DOUBLETS = "لەرزان لەرزین تەزان تەزین لەوەران لەوەرین خزان خزین تەقان تەقین ڕژان ڕژین گەڕان گەڕین سووڕان سووڕین هەڵچوون هەڵچین وەستان وەستین".split()
NEEDS_PREVERB = ("پڕووزان", "پشکنین")
T_STEMS, T_BEFORE, T_AFTER = "خوا دا کا با ڕوا گا شوا خا هاژوا ڕۆ".split(), "اێۆ", ("ەوە", "ە")
NO_CAUSATIVE = ("خوارد", "بوو", "کەوت", "ڕۆیشت", "هات")
PASSIVE_STEMS = ("بران", "دران", "کران", "خران", "نران")
PAST_FINALS = ("ت", "د", "ا", "ی", "وو")
MUTATIONS = {"ژ": "sh_to_zh", "ز": "s_to_z", "ێ": "transitive_a_to_e"}
WANT_STEM, WANT_PRESENT, WANT_FORMS = "ویست", ("دەوێ", "ناوێ", "بوێ"), ("ویست", "ویستن", "ەوێ", "دەوێ", "ناوێ", "بوێ")
NOT_HAVING, NOT_BEING = "نیە", "نییە"

# Endings and beginnings of nouns, and clitics.
NOMINAL = {"ەکان": ("def", "pl"), "یەکان": ("def", "pl"), "ەکە": ("def", None), "یەکە": ("def", None), "ێکیان": ("indef", None), "ییەک": ("indef", None), "ێک": ("indef", None), "یان": (None, "pl"), "ان": (None, "pl")}
DERIVATIONS = (
    "گەر دار وان ەوان چی باز کەر مەند بەند ساز ی ەتی یەتی ایەتی ایی گا گە ستان خانە دان ەڵان لان زار ڵە لە ۆکە ۆک چە وو یلکە چکە وولکە ار یار ەر ۆک ۆکە ک ن"
).split()
NOUN_PREFIXES = ("بەر", "هاو", "ڕا", "پێ")
DIMINUTIVES = "ڵە لە ۆکە ۆک چە وو یلکە چکە وولکە وڵە ۆ".split()
ADJECTIVE_DIMINUTIVES = "ڵە لە چە وو یوو یکی یک ئە ۆکە ێنە اوی ەکی انە".split()
ADVERB_SUFFIXES = ("انە", "یی")
AGENTS = {"transitive_only": ("ەر", "ا", "یار", "گار"), "intransitive_only": ("ۆک", "نۆک", "ەک"), "both": ("نده", "ده", "یده")}
CLITICS = {"مان": ("1", "pl"), "تان": ("2", "pl"), "یان": ("3", "pl"), "م": ("1", "sg"), "ت": ("2", "sg"), "ی": ("3", "sg")}

# Features of vectors and their values, in their order.
FEATURES = {
    "person": ("1", "2", "3"), "number": ("sg", "pl"), "tense": ("present", "past", "future", "imperative", "infinitive"), "aspect": ("habitual", "perfective", "perfect"), "case": ("nom", "obl", "ez"),
    "definiteness": ("def", "indef"), "transitivity": ("trans", "intrans"), "clitic_person": ("1", "2", "3"), "clitic_number": ("sg", "pl"),
}

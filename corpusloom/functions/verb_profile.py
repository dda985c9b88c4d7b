"""Tables of endings, prefixes, stems and markers that the generators of agreement errors use, as plain constants."""

from __future__ import annotations

# Persons, their endings in present and past, what stands for the other number.
NUMBER_FLIP = {"1sg": "1pl", "1pl": "1sg", "2sg": "2pl", "2pl": "2sg", "3sg": "3pl", "3pl": "3sg"}
PRESENT_FORMS = {"1sg": ["م", "ەم"], "2sg": ["یت", "ی", "ێت"], "3sg": ["ێت", "ێ", "ات"], "1pl": ["ین"], "2pl": ["ن"], "3pl": ["ن", "ەن"]}
PRESENT_ENDINGS = {"1sg": "م", "2sg": "یت", "3sg": "ێت", "1pl": "ین", "2pl": "ن", "3pl": "ن"}
PAST_ENDINGS = {"1sg": "م", "2sg": "ت", "3sg": "", "1pl": "مان", "2pl": "تان", "3pl": "یان"}
#: Stems whose third person singular ends otherwise.
AT_STEMS = ("با", "کا", "خا", "شوا", "پوا", "خوا", "گا", "دا")
PREVERBS = ("وەر", "هەڵ", "لێ", "تێ", "دەر", "پێ")
PRESENT_PREFIXES = ("دە", "ئە")

# Past stems of transitive verbs, of verbs in general, and of those that adverbs of time go with.
TRANSITIVE_STEMS = (
    "کرد گوت دیت نووسی خوێند کڕی فرۆشت برد خوارد دا گرت ناسی ویست نارد شکاند ڕشت لایەند فێرکرد شوشت دۆزی هاوشت بەخشی کوشت سووتاند چنی کوتا پوختکرد زانی توانی بینی هێنا تاشی پێچا پاراست خست "
    "بەست بیست کێڵا پێوا سپارد ژمارد بژارد شارد وەستاند خزاند مراند تەقاند ڕژاند کەواند نواند فراند بەزاند"
).split()
PAST_STEMS = (
    "بوو کرد چوو هات گوت دیت نووسی خوێند کڕی فرۆشت برد خوارد دا گرت ناسی گەیشت مرد کەوت نیشت نارد شکاند ڕشت هێنا تاشی پێچا چنی پاراست نووست ڕۆیشت خلیسکا ئاوابوو ڕووخا شەقا هەستا پەڕی دانیشت "
    "ئاورد ئەست خست بەست بیست کێڵا پێوا سپارد ژمارد بژارد شارد کوشت شوشت هاوشت بەخشی سووتا پسا خنکا ڕژا شکا دڕا بڕا ترسا فەوتا گەڕا فڕی وەستا گریا سووڕا هەڵسا سووتاند وەستاند خزاند مراند تەقاند "
    "ڕژاند کەواند نواند فراند بەزاند"
).split()
ADVERB_STEMS = "کرد چوو هات گوت دیت نووسی خوێند کڕی نیشت گەیشت بوو مرد کەوت خوارد دا ناردی بڕی فێربوو زانی وەستا ڕۆیشت گرت کوشت فرۆشت سووتا".split()
PAST_ADVERBS = ("دوێنێ", "پێشتر", "پار", "پاریەک", "پارێ", "تازەگی", "لەمێژەوە", "بەر لە ئێستا")
PRESENT_ADVERBS = ("ئێستا", "سبەی", "سبەینێ", "داهاتوودا", "ئەمڕۆ", "هەمیشە", "بەردەوام")
PAST_TO_PRESENT = {"م": "م", "ت": "یت", "یت": "یت", "ی": "ێت", "مان": "ین", "ین": "ین", "تان": "ن", "یان": "ن", "ن": "ن", "": "ێت"}
PRESENT_TO_PAST = {"م": "م", "ەم": "م", "یت": "ت", "ێت": "", "ات": "", "ێ": "", "ین": "مان", "ن": "ن", "ەن": "ن"}

# Vocatives, conditionals, quantifiers, politeness, conjunctions.
VOWEL_STEMS = ("چۆ", "دۆ", "ڕۆ", "خوا", "خۆ", "ژوا", "وا", "ڕا", "کا", "با", "دا", "ها")
VOCATIVE_PLURAL, VOCATIVE_SINGULAR, VOCATIVE_PARTICLES = "ینۆ", ("ۆ", "ێ"), ("ئەی", "گەلا")
CONDITIONALS = ("ئەگەر", "ئەگەری", "ئەگەرنا")
QUANTIFIERS = (
    "هەموو گشت هەندێک چەند تۆزێک هیچ زۆر کەم فرە یەکێک دوو سێ چوار پێنج شەش حەوت هەشت نۆ دە یازدە دوازدە سێزدە چواردە پازدە شازدە حەڤدە هەژدە نۆزدە بیست سی چل پەنجا شەست حەفتا هەشتا نەوەد سەد هەزار "
    "چەندین چەندێک هەرچەند"
).split()
PLURAL_TO_SINGULAR = {"ین": "م", "ن": "ێت", "ەن": "ێت"}
VERB_LIKE = ("دە", "بـ", "نا", "نە", "مە", "بی", "ب")
POLITE = {
    "فەرموو": ["فەرمون", "تکایە"],
    "فەرمون": ["فەرموو", "تکایە"],
    "تکایە": ["فەرموو", "بێ زەحمەت"],
    "بێ زەحمەت": ["تکایە", "ببوورە"],
    "بە یارمه‌تیت": ["تکایە", "ببوورە"],
    "ببوورن": ["ببوورە", "فەرمون"],
    "ببوورە": ["ببوورن", "فەرموو"],
    "بەڕێزتان": ["تکایە", "ببوورن"],
}
CONJUNCTIONS = ("و", "هەروەها", "پاشان", "بەڵام", "یان")

# Letters that are confused, with weights, and how often a generator is chosen.
CONFUSED_WEIGHTS = {("ل", "ڵ"): 3.0, ("ر", "ڕ"): 3.0, ("ت", "ط"): 1.5, ("د", "ض"): 1.0, ("ز", "ژ"): 1.5}
GENERATOR_WEIGHTS = {
    "subject_verb_number": 3.0, "noun_adjective_agreement": 3.0, "clitic_form": 2.5, "tense_agreement": 2.5, "case_role_preposition": 1.0, "dialectal_participle": 0.5, "relative_clause_ezafe": 1.0,
    "missing_adversative_connector": 0.5, "participle_voice_swap": 0.5, "orthography": 2.0, "negative_concord": 1.0, "vocative_imperative": 0.5, "conditional_agreement": 1.5, "adverb_verb_tense": 1.0,
    "preposition_fusion": 0.5, "demonstrative_contraction": 1.0, "quantifier_agreement": 1.5, "possessive_clitic": 1.5, "polite_imperative": 0.5, "spelling_confusion": 2.0, "word_order": 0.5,
    "whitespace": 1.5, "punctuation": 1.0, "cross_clause_agreement": 0.5, "morpheme_order": 0.5,
}

"""Words that the agreement graph of Central Kurdish sentences looks for, as plain constants."""

from __future__ import annotations

# Stems of past verbs by transitivity, and what changes it.
TRANSITIVE = (
    "کرد گوت دیت نووسی خوێند کڕی فرۆشت برد خوارد دا گرت ناسی ویست نارد شکاند ڕشت لایەند فێرکرد شوشت دۆزی هاوشت بەخشی کوشت سووتاند چنی کوتا پوختکرد زانی توانی بینی هێنا تاشی پێچا پاراست خست بەست بیست کێڵا پێوا سپارد "
    "ژمارد بژارد شارد وەستاند خزاند مراند تەقاند ڕژاند کەواند نواند فراند بەزاند پساند وەراند لێدا پێدا تێکرد ئاژاند ڕاکرد هەڵگرت هەڵدا پێشکەشکرد سەرکرد وەرگرت تەرخانکرد گۆڕی داخست قسەکرد باسکرد کارکرد دەسکرد "
    "گوێگرت پشتگرت"
).split()
INTRANSITIVE = (
    "چوو هات نیشت گەیشت بوو ڕۆیشت مایەوە خەوت نووست گەڕا فڕی وەستا گریا دانیشت هەستا پەڕی سووڕا هەڵسا مرد کەوت خلیسکا ئاوابوو ڕووخا شەقا سووتا پسا خنکا ڕژا شکا دڕا بڕا ترسا فەوتا خزی تەقی بزی کۆکی پژمی ژیا برژا"
).split()
PREFIXES = ("وەر", "هەڵ", "دەر", "دە", "ئە", "نا", "نە", "مە", "لێ", "تێ", "پێ", "ب")
FLIPPING_PREVERB, FLIPPED_ROOTS = "هەڵ", ("کرد", "کوتا", "دا")
LIGHT_VERBS = {
    "کرد": True, "بوو": False, "دا": True, "نا": True, "برد": True, "گرت": True, "هێشت": True, "خوارد": True, "کەوت": False, "هات": False, "چوو": False, "ما": False, "هێنا": True, "کێشا": True, "خست": True,
}
PRESENT_PREFIXES, VERB_PREFIXES, IMPERATIVE_PREFIXES = ("دە", "ئە"), ("دە", "ئە", "نا", "نە", "ب", "مە"), ("ب", "مە")

# Classes of words.
SUBORDINATING = "کە بۆئەوەی کەچی تا هەتا هەتاکوو چونکە ئەگەر گەر مەگەر ئەگەرچی بۆیە".split()
AND, RELATIVE, NEGATIVE_CONJUNCTIONS = "و", "کە", ("نە", "یا")
NOUN_MARKS = ("ەکە", "ەکان", "ێک", "ان", "ین", "یان", "یەکە", "انێک")
PROPER_NOUNS = "هەولێر سلێمانی کوردستان عێراق دهۆک کەرکووک بەغدا سۆران بادینان ئەربیل موسڵ ئامەد مەهاباد سنە ڕانیە چوارتا حەڵەبجە".split()
MASS_NOUNS = "شیر گەنم برنج ئاو خۆڵ خوێن نان هەوا دارو نەفت ئاسن ئالتوون قوماش پارە هەناسە".split()
MEASURES = "پەرداخ لبا گلاس کیلۆ تۆن لیتر پارچە دانە بۆتل تەشت گۆنی قاپ".split()
COLLECTIVES = "لەشکەر گەل خەڵک ئایل خێزان کۆمەڵ جەماوەر سوپا دەستە پۆلیس مەڕ هێڵ جووتیار".split()
UNIVERSAL, NOT_BARE_AFTER = ("هەموو", "گشت"), ("هەموو", "گشت", "هەر", "چەند")
INDEFINITE_QUANTIFIERS, RECIPROCAL_VARIANTS = ("زۆر", "کەم", "هەندێ", "چەند"), ("یەکتر", "یەکدی", "یەکدوو", "هەڤ", "هەڤدو")
INVARIANT_PRONOUNS, POSSESSIVES = ("خۆم", "خۆت", "خۆی", "خۆمان", "خۆتان", "خۆیان", "کێ", "چی", "کام", "یەکتر", "یەکدی"), ("مم", "ت", "ی", "مان", "تان", "یان")
EXISTENTIAL_FORMS, EXISTENTIAL_STEMS = ("هەیە", "نییە", "هەبێت", "نەبێت", "هەن"), ("هەبوو", "نەبوو", "بوو")
NEVER, CONDITIONALS, CALLS = "هەرگیز", ("ئەگەر", "گەر", "مەگەر", "ئەگەرچی"), ("هۆ", "هێ", "ۆ")
CALL_ENDINGS, PATIENT_ENDING, AGENT_ENDING = ("ۆ", "ێ"), "و", "ر"
PRE_HEAD = "هەر تەنیا ئەم ئەو زۆر هەندێ یەکجار کەمێک چەند هیچ مامۆستا دکتۆر پرۆفیسۆر ئەندازیار پزیشک".split()

# How many tokens a relation reaches, and the order of the types of edges.
SUBJECT_REACH, BACKWARD_REACH, OBJECT_REACH, QUANTIFIER_REACH, CLITIC_REACH, CALL_REACH, NEVER_REACH, CONDITION_REACH, ANTECEDENT_REACH, RELATIVE_REACH = 8, 7, 9, 10, 7, 6, 6, 8, 6, 9
EDGE_TYPES = (
    "subject_verb object_verb_ergative object_verb_ergative_zero agent_non_agreeing clitic_agent clitic_patient noun_det adjective_invariant quantifier_verb measure_word_verb mass_noun_no_agreement collective_singular "
    "collective_plural dem_det_noun dem_proform_verb vocative_imperative relative_clause adverb_verb_tense possessive_no_agreement oblique_no_agreement conditional_agreement pro_drop_agreement passive_subject_verb "
    "backward_subject_verb def_marker_migration ezafe_allomorph existential_possession numeral_forces_singular reciprocal_verb gender_vocative ezafe_possessive participial_modification reflexive_agreement"
).split()

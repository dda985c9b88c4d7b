"""Language data of Central Kurdish in Arabic script, as plain constants."""

from __future__ import annotations

# Character classes and maps.
ARABIC = "؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿"
HEH_CONTEXT = "ء-غف-يٮ-۔ە-ۯۺ-ۿݐ-ݿ"
TOKEN_LETTERS = "ء-غف-يٮ-ۓە-ۯۺ-ۿݐ-ݿﭐ-﷿ﹰ-﻿‌"
CHAR_MAP = {"ك": "ک", "ي": "ی", "ى": "ی", "ة": "ە"} | {chr(0x30 + i): chr(0x6F0 + i) for i in range(10)} | {chr(0x660 + i): chr(0x6F0 + i) for i in range(10)}
TATWEEL, ZWNJ, ZWJ = "ـ", "‌", "‍"
#: White space of Unicode, as (?U)\s has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ZERO_WIDTH = "​‍‎‏﻿"
DIACRITICS = "ًٌٍَُِّْٰ"
WAW_BEFORE = "ئابتجحخدذرزسشصضطظعغفقكلمنهکگڵیێەپڕژڤڶ"
NO_SPACE_BEFORE = "،؛؟۔.!:;)]}»"
DISTINCT_LETTERS = "ڕڵێۆەڤژگپچک"
KURDISH_CHARS, KURDISH_ONLY_CHARS = "ڕڵڤۆێەپچگژ", "ڕڵۆێ"
BOILERPLATE = ("ئەم بابەتە بچووکە", "سەرچاوەکان دیاری نەکراون", "ئەم بابەتە پێویستی بە", "بابەتی سەرەکی")
ABBREVIATIONS = ("د.", "ب.", "پ.", "م.", "ژ.", "ل.", "هتد.", "بڕ.")

# Function words.
CKB_WORDS = ("من تۆ ئەو ئێمە ئێوە ئەوان ئەم ئەمە ئەوە لە بۆ لەگەڵ بە لەسەر لەبەر لەژێر لەنێو لەپێش لەدوای تا بەبێ و کە بەڵام یان چونکە بۆیە ئەگەر هەر تەنها هەروەها کێ چی کەی چۆن کوێ چەند هەیە نیە نییە زۆر کەم هیچ هەموو خۆ باش دەبێت دەکرێت ناکرێت نابێت").split()
KMR_WORDS = "ez tu ew em hûn ewan ji bi di li nav ser ber jêr lê belê çimkî eger de ne ye in ژی دی ناڤ".split()
ARB_WORDS = "في من إلى على هذا هذه ذلك التي الذي أن لا ما هو هي كان عن مع قد بين ثم أو حتى إذا لم لن".split()
FAS_WORDS = "است این آن را که با از به برای تا یا اگر ولی اما هم می نمی خواهد شد بود".split()

# Categories in their order, hints, directories.
CATEGORIES = ("linguistics", "literature", "history", "education", "law", "political_science", "social_sciences", "sciences", "engineering", "computer_science", "economics", "islamic_studies", "media", "general")
HINTS = {
    "linguistics": "زمان ڕێزمان ڕستەساز مۆرفۆلۆج سینتاکس سیمانتیک فۆنۆلۆج وشەساز زمانەوان morpho syntax linguistic grammar phonolog".split(),
    "literature": "ئەدەب شیعر ڕۆمان چیرۆک نووسەر ڕەخنە literature poetry novel narrative".split(),
    "history": "مێژوو تاریخ شاری شوێن history historical archeolog ancient".split(),
    "education": "پەروەردە خوێندن فێرکردن مامۆستا قوتابخانە education pedagog curricul teaching".split(),
    "law": "یاسا دادگا دەستوور تاوان مافی law legal constitution criminal justice".split(),
    "political_science": "سیاس حزب دیمۆکراس حکومەت فیدراڵ politic democra govern federal".split(),
    "social_sciences": "کۆمەڵ دەروون ئابووری فەلسەفە social psycholog sociol anthropol philosophy".split(),
    "sciences": "فیزیا کیمیا بایۆلۆج ژینگە بیرکاری physics chemistr biolog environment math".split(),
    "engineering": "ئەندازیار تەلارساز شارساز ئاو وزە engineer architect civil mechanical electric".split(),
    "computer_science": "کۆمپیوتەر زانیاری بەرنامەساز تەکنەلۆج computer software algorithm data network AI".split(),
    "economics": "ئابووری بازار بانک بازرگانی econom market financ trade business".split(),
    "islamic_studies": "ئیسلام قورئان فیقه شەریعە تەفسیر islam quran sharia theology".split(),
    "media": "میدیا ڕۆژنامە ڕاگەیاندن تەلەفزیۆن media journal broadcast press".split(),
}
DIRECTORY_CATEGORY = {"economy": "economics", "genocide": "history", "geography": "social_sciences", "history": "history", "human-rights": "law", "kurdish": "linguistics", "kurdology": "linguistics", "philosophy": "social_sciences", "physics": "sciences", "social-study": "social_sciences", "sociology": "social_sciences", "theology": "islamic_studies"}

#: Letters for letters, so that Latin-script text exercises operators on Arabic script.
LATIN, SCRIPT = "abcdefghijklmnopqrstuvwxyz", "ابچدەفگهیژکلمنۆپقرستوڤڵخێز"

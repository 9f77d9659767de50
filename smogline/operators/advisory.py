"""Health advice per index category, language and region."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from smogline import constants as K
from smogline.functions import aqi
from smogline.operators import matching

PERSONAS = ["general", "sensitive", "farmer", "traffic_worker", "outdoor_worker", "schools"]
TEMPLATE_COLUMNS = ["language", "category", "headline", "summary", "mask", "ventilation", *PERSONAS]

# Built-in texts, worded for this library.  Deployments pass their own
# template table (any languages) with the columns above.
_ENGLISH = {
    "Good": ("Clean air", "Air is clean; enjoy the outdoors.", "No mask needed", "Open the windows",
             "No limits", "No limits", "Field work is fine", "Normal duty", "Normal work", "Outdoor sports are fine"),
    "Satisfactory": ("Acceptable air", "Air is acceptable; the very sensitive should watch for symptoms.",
                     "Optional for sensitive people", "Airing is fine by day",
                     "Normal activity", "Take breaks on hard exercise", "Do not burn residue", "Cover up near fumes",
                     "Rest and drink", "Normal sports"),
    "Moderate": ("Moderately polluted", "Lung and heart patients may feel discomfort.", "Mask on busy roads",
                 "Close road-side windows at rush hour",
                 "Avoid long runs near traffic", "Carry inhalers", "Wet the soil before tilling", "Wear a mask on duty",
                 "Spray dusty ground", "Move endurance sports indoors"),
    "Poor": ("Poor air", "Long exposure troubles most people.", "N95 outdoors", "Keep windows shut",
             "Skip outdoor workouts", "Stay indoors", "No burning at all", "N95 and shorter shifts",
             "Mist dusty sites; N95", "Cancel outdoor events"),
    "Very Poor": ("Very poor air", "Illness is likely on long exposure.", "N95 or better always", "Do not air out",
                  "Avoid travel", "Stay in filtered air", "Only essential field work", "45-minute turns with N95",
                  "Stop dusty work", "Keep pupils indoors"),
    "Severe": ("Air emergency", "Even short exposure harms healthy people.", "N99 if outdoors", "Seal the rooms",
               "Stay indoors", "Seek help on symptoms", "Stop field work", "Work from closed cabins",
               "Stop outdoor work", "Close schools"),
}
_MARATHI = {
    "Good": ("स्वच्छ हवा", "हवा स्वच्छ आहे; बाहेर मोकळेपणाने फिरा.", "मास्कची गरज नाही", "खिडक्या उघड्या ठेवा",
             "कोणतीही मर्यादा नाही", "कोणतीही मर्यादा नाही", "शेतीची कामे सुरू ठेवा", "नेहमीप्रमाणे सेवा", "नेहमीप्रमाणे काम", "मैदानी खेळ चालतील"),
    "Satisfactory": ("हवा ठीक आहे", "हवा स्वीकारार्ह आहे; अतिसंवेदनशील व्यक्तींनी त्रासाकडे लक्ष द्यावे.", "संवेदनशील व्यक्तींसाठी ऐच्छिक", "दिवसा खिडक्या उघडता येतील",
                     "नेहमीची कामे करा", "कठीण व्यायामात विश्रांती घ्या", "पिकांचे अवशेष जाळू नका", "धुराजवळ नाक झाका", "विश्रांती घ्या व पाणी प्या", "नेहमीचे खेळ"),
    "Moderate": ("मध्यम प्रदूषण", "फुफ्फुस व हृदयाच्या रुग्णांना त्रास होऊ शकतो.", "गर्दीच्या रस्त्यांवर मास्क", "गर्दीच्या वेळी रस्त्याकडील खिडक्या बंद ठेवा",
                 "रहदारीजवळ लांब धावणे टाळा", "इनहेलर जवळ ठेवा", "नांगरणीपूर्वी माती ओली करा", "कामावर मास्क वापरा", "धुळीच्या जागेवर पाणी फवारा", "दमछाक करणारे खेळ घरात घ्या"),
    "Poor": ("खराब हवा", "जास्त वेळ बाहेर राहिल्यास बहुतेकांना त्रास होतो.", "बाहेर N95 मास्क", "खिडक्या बंद ठेवा",
             "बाहेरील व्यायाम टाळा", "घरातच राहा", "काहीही जाळू नका", "N95 आणि लहान पाळ्या", "धूळ दाबा; N95 वापरा", "बाहेरील कार्यक्रम रद्द करा"),
    "Very Poor": ("अतिशय खराब हवा", "जास्त वेळ बाहेर राहिल्यास आजार संभवतो.", "नेहमी N95 किंवा त्याहून चांगला", "हवा खेळती ठेवू नका",
                  "प्रवास टाळा", "शुद्ध हवेच्या खोलीत राहा", "फक्त अत्यावश्यक शेतीकाम", "N95 सह ४५ मिनिटांच्या पाळ्या", "धुळीची कामे थांबवा", "विद्यार्थ्यांना वर्गात ठेवा"),
    "Severe": ("हवेची आणीबाणी", "थोडा वेळही निरोगी व्यक्तींना घातक आहे.", "बाहेर पडल्यास N99", "खोल्या बंद करून घ्या",
               "घरातच राहा", "त्रास झाल्यास उपचार घ्या", "शेतीकाम थांबवा", "बंद केबिनमधून काम करा", "बाहेरील काम थांबवा", "शाळा बंद ठेवा"),
}
_HINDI = {
    "Good": ("स्वच्छ हवा", "हवा साफ़ है; बाहर का आनंद लें.", "मास्क ज़रूरी नहीं", "खिड़कियाँ खुली रखें",
             "कोई रोक नहीं", "कोई रोक नहीं", "खेत का काम जारी रखें", "सामान्य ड्यूटी", "सामान्य काम", "मैदानी खेल ठीक हैं"),
    "Satisfactory": ("हवा ठीक है", "हवा स्वीकार्य है; अति संवेदनशील लोग लक्षणों पर ध्यान दें.", "संवेदनशील लोगों के लिए ऐच्छिक", "दिन में खिड़कियाँ खोल सकते हैं",
                     "सामान्य गतिविधि", "कठिन व्यायाम में रुककर आराम करें", "पराली न जलाएँ", "धुएँ के पास चेहरा ढकें", "आराम करें और पानी पिएँ", "सामान्य खेल"),
    "Moderate": ("मध्यम प्रदूषण", "फेफड़े और हृदय के रोगियों को परेशानी हो सकती है.", "व्यस्त सड़कों पर मास्क", "भीड़ के समय सड़क की ओर की खिड़कियाँ बंद रखें",
                 "यातायात के पास लंबी दौड़ से बचें", "इनहेलर साथ रखें", "जुताई से पहले मिट्टी गीली करें", "ड्यूटी पर मास्क पहनें", "धूल वाली जगह पर पानी छिड़कें", "थकाने वाले खेल अंदर कराएँ"),
    "Poor": ("ख़राब हवा", "देर तक बाहर रहने से अधिकतर लोगों को तकलीफ़ होती है.", "बाहर N95 मास्क", "खिड़कियाँ बंद रखें",
             "बाहर व्यायाम न करें", "घर में रहें", "कुछ भी न जलाएँ", "N95 और छोटी पालियाँ", "धूल दबाएँ; N95 पहनें", "बाहरी कार्यक्रम रद्द करें"),
    "Very Poor": ("बहुत ख़राब हवा", "देर तक बाहर रहने से बीमारी हो सकती है.", "हमेशा N95 या बेहतर", "कमरे में बाहर की हवा न आने दें",
                  "यात्रा से बचें", "साफ़ हवा वाले कमरे में रहें", "केवल ज़रूरी खेत का काम", "N95 के साथ 45 मिनट की पालियाँ", "धूल वाला काम रोकें", "बच्चों को कक्षा में रखें"),
    "Severe": ("हवा का आपातकाल", "थोड़ी देर भी स्वस्थ लोगों के लिए हानिकारक है.", "बाहर जाना हो तो N99", "कमरे बंद रखें",
               "घर में रहें", "लक्षण दिखें तो इलाज लें", "खेत का काम रोकें", "बंद केबिन से काम करें", "बाहर का काम रोकें", "स्कूल बंद रखें"),
}
TEXTS = {"en": _ENGLISH, "mr": _MARATHI, "hi": _HINDI}


def default_templates(spark: SparkSession) -> DataFrame:
    """Built-in advice in English, Marathi and Hindi: one row per language and category."""
    return spark.createDataFrame([(language, c, *t) for language, texts in TEXTS.items() for c, t in texts.items()], TEMPLATE_COLUMNS)


def advisory_lookup(points: DataFrame, templates: DataFrame, districts: DataFrame, regional_notes: DataFrame,
                    index: str = "aqi", language: str = "language") -> DataFrame:
    """Category, template texts, nearest district and its region's note for every point.

    ``districts`` has id, name, region, lat, lon; ``regional_notes`` has region, language, note.
    An unknown language, and a category without a template in the language asked for, read English; a region without a note gives an empty one.
    """
    lang = F.when(F.col(language).isin(*K.CATEGORY_NAMES_LOCAL), F.col(language)).otherwise("en")
    name = aqi.category(F.col(index))
    local = F.lit(None).cast("string")
    for code, names in K.CATEGORY_NAMES_LOCAL.items():
        for label, text in names.items():
            local = F.when((F.col("language") == code) & (F.col("category") == label), F.lit(text)).otherwise(local)
    named = points.withColumns({
        "language": lang, "category": F.when(name == K.UNKNOWN_CATEGORY[0], "Moderate").otherwise(name)})
    placed = matching.nearest_reference_point(named, districts.withColumnRenamed("name", "district"),
                                              ["district", "region"], ["id"], "latitude", "longitude")
    texts = [c for c in TEMPLATE_COLUMNS if c not in ("language", "category")]
    english = templates.filter(F.col("language") == "en").select("category", *[F.col(c).alias(f"_en_{c}") for c in texts])
    # a template is there or not as a whole: an empty text of its own is no gap
    own = templates.withColumn("_own", F.lit(True))
    advised = placed.join(own, ["language", "category"], "left").join(english, "category", "left")
    advised = advised.withColumns({c: F.when(F.col("_own"), F.col(c)).otherwise(F.col(f"_en_{c}")) for c in texts}).drop("_own", *[f"_en_{c}" for c in texts])
    noted = advised.join(regional_notes.select("region", "language", F.col("note").alias("_n")),
                         ["region", "language"], "left")
    return noted.withColumns({
        "aqi_rounded": F.bround(F.col(index).cast("double"), 1), "category_localized": local,
        "color": aqi.advisory_color(F.col("category")), "regional_note": F.coalesce("_n", F.lit(""))}).drop("_n")


def personas_struct() -> list:
    """The six persona texts as one nested column."""
    return [F.struct(*[F.col(p) for p in PERSONAS]).alias("personas")]

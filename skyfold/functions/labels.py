"""Labels in Hindi and English for scenarios, risks, categories, reasons and options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skyfold.functions.text import replace_all, translate_label

# Labels shown to users.
SCENARIOS_HI = {
    "heat_stress": "लू और गर्मी का तनाव",
    "delayed_monsoon": "मानसून में देरी / बुवाई में देरी",
    "early_season_dry_spell": "मौसम की शुरुआत में सूखा दौर",
    "mid_season_break": "मानसून में मध्य-मौसम विराम",
    "terminal_drought": "अंतिम सूखा / मानसून की जल्दी वापसी का जोखिम",
    "excess_rainfall_waterlogging": "अधिक वर्षा / जलभराव",
}
RISKS_HI = {"Severe": "गंभीर", "Alert": "सतर्कता", "Watch": "निगरानी", "Low": "कम"}
CATEGORIES_HI = {
    "Much wetter than normal": "सामान्य से बहुत अधिक वर्षा",
    "Wetter than normal": "सामान्य से अधिक वर्षा",
    "Slightly wetter": "थोड़ी अधिक वर्षा",
    "Near normal": "सामान्य के आसपास",
    "Slightly drier": "थोड़ी कम वर्षा",
    "Drier than normal": "सामान्य से कम वर्षा",
    "Much drier than normal": "सामान्य से बहुत कम वर्षा",
    "Very warm": "बहुत गर्म",
    "Warm": "गर्म",
    "Slightly warm": "थोड़ा गर्म",
    "Slightly cool": "थोड़ा ठंडा",
    "Cool": "ठंडा",
    "Very cool": "बहुत ठंडा",
}
REASONS_HI = {
    "Heat wave warning is in effect": "लू की चेतावनी लागू है",
    "Maximum temperatures are above normal": "अधिकतम तापमान सामान्य से अधिक है",
    "Minimum temperatures are above normal": "न्यूनतम तापमान सामान्य से अधिक है",
    "Humidity heat index is high": "नमी वाला हीट इंडेक्स अधिक है",
    "Rainfall since June 1 is": "1 जून से वर्षा",
    "below normal": "सामान्य से कम",
    "above normal": "सामान्य से अधिक",
    "Monsoon onset is delayed": "मानसून का आगमन देर से है",
    "The first forecast week is below normal": "पहले पूर्वानुमान सप्ताह में वर्षा सामान्य से कम है",
}
OPTIONS_HI = {
    "user_type": {
        "Farmer": "किसान",
        "Livestock owner": "पशुपालक",
        "Outdoor worker": "बाहरी कामगार",
        "Village official": "ग्राम अधिकारी",
        "NGO / extension worker": "एनजीओ / कृषि विस्तार कार्यकर्ता",
        "Health worker": "स्वास्थ्य कार्यकर्ता",
    },
    "irrigation": {
        "Rainfed": "वर्षा आधारित",
        "Partial irrigation": "आंशिक सिंचाई",
        "Assured irrigation": "सुनिश्चित सिंचाई",
        "Unknown": "ज्ञात नहीं",
    },
    "crop_stage": {
        "Not sown": "बुवाई नहीं हुई",
        "Recently sown": "हाल ही में बोई गई",
        "Vegetative": "वानस्पतिक अवस्था",
        "Flowering / reproductive": "फूल आने / प्रजनन की अवस्था",
        "Harvesting": "कटाई",
        "Unknown": "ज्ञात नहीं",
    },
}


def scenario_name(key: Column, english: Column, language: str = "en") -> Column:
    """Name of a scenario; its English name where there is no other."""
    if language != "hi":
        return english
    named = translate_label(key, SCENARIOS_HI)
    return F.when(named == key, english).otherwise(named)


def risk_name(risk: Column, language: str = "en") -> Column:
    return translate_label(risk, RISKS_HI) if language == "hi" else risk


def category_name(category: Column, language: str = "en") -> Column:
    return translate_label(category, CATEGORIES_HI) if language == "hi" else category


def reason_text(reason: Column, language: str = "en") -> Column:
    """A reason with its stable phrases replaced."""
    return replace_all(reason, REASONS_HI) if language == "hi" else reason


def option_label(kind: str, value: Column, language: str = "en") -> Column:
    return translate_label(value, OPTIONS_HI.get(kind, {})) if language == "hi" and kind in OPTIONS_HI else value


def option_value(kind: str, label: Column, language: str = "en") -> Column:
    """The value behind a shown label; the label itself where it is none."""
    if language != "hi" or kind not in OPTIONS_HI:
        return label
    return translate_label(label, {shown: value for value, shown in OPTIONS_HI[kind].items()})

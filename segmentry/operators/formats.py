"""The formats that redaction looks for, each as its pattern, in the order in which they are applied.

Results depend on these values, so they stand here as plain text. ``\\b``, ``\\w``, ``\\d`` and ``\\s`` are meant for Unicode;
groups named in ``ANY_CASE`` are met without regard to case.
"""

from __future__ import annotations

# Fixed values from here on.
SAFE: dict[str, dict[str, str]] = {
    "identifiers": {
        "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
        "nct": r"\bNCT\d{8}\b",
        "isrctn": r"\bISRCTN\d{8}\b",
        "jrct": r"\bjRCT[a-zA-Z]?\d{7,10}\b",
        "ctri": r"\bCTRI[/\-]\d{4}[/\-]\d{2,3}[/\-]\d{5,6}\b",
        "anzctr": r"\bACTRN\d{14}\b",
        "chictr": r"\bChiCTR[-]?(?:[A-Z]{2,4}[-]?)?\d{7,10}\b",
        "drks": r"\bDRKS\d{8}\b",
        "irct": r"\bIRCT\d{14,}\b",
        "umin": r"\bUMIN\d{9}\b",
        "kct": r"\bKCT\d{7}\b",
        "eu_ct": r"\bEU[-\s]?CT\s*\d{4}[-\s]?\d{4,6}[-\s]?\d{2}[-\s]?\d{2}\b",
        "nif_es": r"\b(?:NIF|CIF|DNI|NIE)[\s:.-]*[A-Z]?\d{7,8}[-]?[A-Z]?\b",
        "dni_alone": r"\b\d{8}[-]?[A-Z]\b",
        "nif_alone": r"\b[A-Z]\d{7,8}[-]?[A-Z]?\b",
        "ssn_us": r"\b(?:SSN|Social\s+Security)[\s:.-]*\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
        "ssn_us_alone": r"\b\d{3}[-]\d{2}[-]\d{4}\b",
        "ein_us": r"\b(?:EIN|Tax\s+ID)[\s:.-]*\d{2}[-]?\d{7}\b",
        "nino_uk": r"\b(?:NINO|National\s+Insurance)[\s:.-]*[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b",
        "nino_uk_alone": r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b",
        "nhs_uk": r"\b(?:NHS)[\s:.-]*\d{3}\s?\d{3}\s?\d{4}\b",
        "secu_fr": r"\b(?:Sécurité\s+Sociale|INSEE|Numéro\s+SS|N°?\s*SS)[\s:.-]*[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b",
        "secu_fr_alone": r"\b[12]\s?\d{2}\s?(?:0[1-9]|1[0-2]|[2-9]\d)\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b",
        "codice_it": r"\b(?:Codice\s+Fiscale|CF)[\s:.-]*[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
        "codice_it_alone": r"\b[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]\b",
        "iva_it": r"\b(?:P\.?\s*IVA|Partita\s+IVA)[\s:.-]*(?:IT)?\d{11}\b",
        "nif_pt": r"\b(?:NIF|NIPC|Contribuinte)[\s:.-]*[123568]\d{8}\b",
        "cc_pt": r"\b(?:Cartão\s+de\s+Cidadão|CC)[\s:.-]*\d{8}\s?\d\s?[A-Z]{2}\d\b",
        "bsn_nl": r"\b(?:BSN|Burgerservicenummer)[\s:.-]*\d{9}\b",
        "niss_be": r"\b(?:NISS|Rijksregisternummer|Registre\s+National)[\s:.-]*\d{2}[\.\s]?\d{2}[\.\s]?\d{2}[-\s]?\d{3}[-\.\s]?\d{2}\b",
        "ahv_ch": r"\b(?:AHV|AVS|OASI)[\s:.-]*756[\.\s]?\d{4}[\.\s]?\d{4}[\.\s]?\d{2}\b",
        "cpf_br": r"\b(?:CPF)[\s:.-]*\d{3}[\.\s]?\d{3}[\.\s]?\d{3}[-\s]?\d{2}\b",
        "cnpj_br": r"\b(?:CNPJ)[\s:.-]*\d{2}[\.\s]?\d{3}[\.\s]?\d{3}[/\s]?\d{4}[-\s]?\d{2}\b",
        "curp_mx": r"\b(?:CURP)[\s:.-]*[A-Z]{4}\d{6}[HM][A-Z]{5}[A-Z\d]{2}\b",
        "pps_ie": r"\b(?:PPS|PPSN)[\s:.-]*\d{7}[A-Z]{1,2}\b",
        "resident_cn": r"(?:身份证(?:号(?:码)?)?|居民身份证)[\s:：]*[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]",
        "resident_cn_alone": r"(?<!\d)[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)",
        "my_number_jp": r"(?:マイナンバー|個人番号)[\s:：]*\d{4}\s?\d{4}\s?\d{4}",
        "parts": r"\b[A-Z]{2,5}[-][A-Z]{2,5}[-][A-Z0-9]{2,8}(?:[-][A-Z0-9]{1,5})?\b",
        "mixed": r"\b[A-Z]{2,6}[-][A-Z0-9]{2,10}[-][A-Z0-9]{2,10}(?:[-][A-Z0-9]{1,6})?\b",
        "structured": r"\b[A-Z]{2,6}[-_/]\d{2,8}\b",
        "long_number": r"\b\d{3,}(?:[-./]\d{2,})+\b|\b\d{6,}[A-Za-z]*\b",
        "iban": r"\b[A-Z]{2}\d{2}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{4}[\s]?\d{0,4}\b",
        "social_es": r"\b\d{2}[-/]\d{7,8}[-/]\d{2}\b",
        "card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
        "url": r"(?:https?://)[^\s]+",
        "domain": r"\b[A-Za-z0-9][-A-Za-z0-9]*(?:\.[A-Za-z0-9][-A-Za-z0-9]*)*\.(?:gov|edu|org|com|net|int|eu|es|uk|de|fr|it|pt|nl|be|at|ch|co|info|mil|ai)(?:/[^\s,.)]*)?",
        "ip": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
        "trademark": r"\b[A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9\-]*(?:\s+[A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9\-]*){0,3}\s*[®™]",
        "copyright": r"[©]\s*(?:\d{4}\s+)?[A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9\-]+(?:\s+[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9\-]+){0,3}(?!\w)",
    },
    "phone": {
        "plus": r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{0,4}\b",
        "zeros": r"\b00\d{1,3}[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4}\b",
        "brackets": r"\(\d{2,4}\)\s*\d{3,4}[-.\s]?\d{3,4}\b",
        "labelled": r"\b(?:Tel|Phone|Fax|Mobile|Cell|Tfno|Teléfono|Telefon|Telefono|Téléphone|Telefoon|Cellulare|Portable|Handy|Mobiel)[-:\s]*[+]?\d[\d\s\-().]{7,18}\b",
        "nine": r"\b9\d{2}[-.\s]?\d{3}[-.\s]?\d{3}\b",
        "six_seven": r"\b[67]\d{2}[-.\s]?\d{3}[-.\s]?\d{3}\b",
        "grouped": r"\b\d{2,4}[\s-]\d{3,4}(?:[\s-]\d{2,4}){1,}\b",
    },
    "address": {
        "street_en": r"\b\d{1,5}\s+(?:[A-Z][a-zÀ-ÿ]+|\d{1,3}(?:st|nd|rd|th))(?:\s+(?:[A-Z][a-zÀ-ÿ]+|\d{1,3}(?:st|nd|rd|th)))*\s+(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?|Way|Court|Ct\.?|Place|Pl\.?|Parkway|Pkwy\.?|Highway|Hwy\.?)\b",
        "street_de_nl": r"\b\d{1,5}\s+[A-Z][a-zÀ-ÿ]+(?:straat|weg|laan|plein|gracht|kade|singel|dijk|straße|stra[ßs]e|platz|allee)\b",
        "building": r"\b(?:Building|Bldg|Block|Tower|Floor|Room|Office|Edificio|Étage|Piano|Gebäude|Verdieping)\s*[#:]?\s*[A-Z0-9]+\s*,\s*\d{1,5}\s+[A-Za-z]+\b",
        "street_es": r"\b(?:[Cc]alle|[Aa]venida|[Aa]vda|[Pp]aseo|[Pp]laza|[Cc]amino|[Cc]arretera|[Rr]onda|[Tt]ravesía|[Gg]lorieta|[Cc]/|[Cc]\.\s|[Aa]v\.)\s*(?:(?:de|del|de\s+la|de\s+el|de\s+los|de\s+las)\s+)?[A-ZÀ-ÿa-zÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿa-zÀ-ÿ][a-zÀ-ÿ]+){0,3}\s*(?:[,]\s*)?(?:(?:nº?\s*|#\s*)?\d{1,4})?\b",
        "labelled": r"\b(?:[Dd]irección|[Aa]ddress|[Aa]dresse|[Ii]ndirizzo|[Aa]dres)[-:\s]+[A-ZÀ-ÿa-zÀ-ÿ].{5,60}(?:\d{4,5}\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+)\b",
        "street_fr": r"\b(?:[Rr]ue|[Bb]oulevard|[Aa]venue|[Pp]lace|[Cc]hemin|[Ii]mpasse)\s+(?:de\s+la\s+|du\s+|des\s+|de\s+|d')?[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿa-zÀ-ÿ][a-zÀ-ÿ]+){0,3}\s*(?:[,]\s*)?(?:\d{1,4})?\b",
        "street_it": r"\b(?:[Vv]ia|[Vv]iale|[Pp]iazza|[Cc]orso|[Ll]argo|[Vv]icolo)\s+(?:della?\s+|delle?\s+|degli?\s+|dei?\s+)?[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿa-zÀ-ÿ][a-zÀ-ÿ]+){0,3}\s*(?:[,]\s*)?(?:\d{1,4})?\b",
        "street_pt": r"\b(?:[Rr]ua|[Aa]venida|[Pp]raça|[Tt]ravessa|[Ll]argo)\s+(?:da\s+|do\s+|das\s+|dos\s+|de\s+)?[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿa-zÀ-ÿ][a-zÀ-ÿ]+){0,3}\s*(?:[,]\s*)?(?:(?:nº?\s*|#\s*)?\d{1,4})?\b",
    },
    "postal": {
        "labelled": r"\b(?:CP|C\.P\.|Código\s+Postal|Postcode|ZIP|PLZ|CAP|Code\s+Postal|Postcode|Postbus)[-:\s]*\d{4,6}[-\s]?[A-Z]{0,2}\b",
        "uk": r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}\b",
        "ca": r"\b[A-Z]\d[A-Z]\s*\d[A-Z]\d\b",
        "nl": r"\b\d{4}\s?[A-Z]{2}\b",
        "with_country": r"\b\d{5}\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s*,\s*|\s+)(?:Spain|España|Germany|Deutschland|France|Francia|Italia|Italy|Portugal|Netherlands|Nederland|Belgium|Belgique|België|Switzerland|Suisse|Schweiz|Svizzera|Brazil|Brasil|Mexico|México|Ireland|Irlanda)\b",
        "after_comma": r",\s*\d{5}\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+\b",
    },
    "titled": {
        "academic": r"\b(?:Dr|Dra|Prof|Professor|Doctor|Doctora|Dott|Dott\.ssa|Professore|Professoressa|Docteur|Professeur)\.?\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,3}\b",
        "english": r"\b(?:Mr|Mrs|Ms|Miss|Sir|Lady|Lord)\.?\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,3}\b",
        "spanish": r"\b(?:Don|Doña|Sr|Sra|Srta|Lic|Ing|Arq|Abog|Mtro|Mtra)\.?\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,3}\b",
        "european": r"\b(?:Herr|Frau|Monsieur|Madame|Mme|Mlle|Sig|Sig\.ra|Dhr|Mevr|Mevrouw|Meneer)\.?\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,3}\b",
        "degree": r"\b[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2},?\s*(?:MD|M\.D\.|PhD|Ph\.D\.|PharmD|Pharm\.D\.|DO|D\.O\.|RN|R\.N\.|NP|PA|MBBS|FRCP|FACP|FACS|DDS|DMD|OD|DPM|DC)\b",
        "role": r"\b(?:Principal\s+Investigator|Sub-?[Ii]nvestigator|Study\s+Coordinator|Site\s+Director|Medical\s+Monitor|Study\s+Physician|Investigador\s+Principal|Investigateur\s+Principal|Hauptprüfer|Prüfarzt|Ricercatore\s+Principale)[\s:]+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\b",
        "short_role": r"\b(?:PI|Co-?PI|SI)[\s:]+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\b",
    },
    "birth": {
        "labelled": r"\b(?:DOB|D\.O\.B\.|Date\s+of\s+Birth|Birth\s*Date|Fecha\s+de\s+Nacimiento|Geburtsdatum|Date\s+de\s+Naissance|Data\s+di\s+Nascita|Geboortedatum|Data\s+de\s+Nascimento)[-:\s]*\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}\b",
        "labelled_month": r"\b(?:DOB|D\.O\.B\.|Date\s+of\s+Birth|Birth\s*Date)[-:\s]*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-.\s]*\d{1,2}[-,.\s]*\d{2,4}\b",
        "born": r"\b(?:Born|Nacido|Nacida|Né|Née|Geboren|Nato|Nata|Nascido|Nascida)[-:\s]*(?:on\s+|el\s+|le\s+|il\s+|am\s+|em\s+)?(?:\d{1,2}[-/\.]\d{1,2}[-/\.]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*[-.\s]*\d{1,2}[-,.\s]*\d{2,4})\b",
        "cjk": r"(?:出生日期|生年月日|生日)[\s:：]*\d{4}[年/\-\.]\d{1,2}[月/\-\.]\d{1,2}[日]?",
        "japanese": r"\d{4}年\d{1,2}月\d{1,2}日生(?:まれ)?",
    },
    "cjk": {
        "chinese_titled": r"[一-鿿]{1,4}(?:医生|醫生|大夫|主任|教授|博士|院士|先生|女士|小姐)",
        "chinese_title_first": r"(?:医生|醫生|大夫|主任|教授|博士|院士)[\s:：]*[一-鿿]{2,4}",
        "japanese_titled": r"[一-鿿぀-ゟ゠-ヿ]{1,5}(?:先生|様|氏|さん|博士|教授|医師)",
        "japanese_title_first": r"(?:医師|博士|教授)[\s:：]*[一-鿿぀-ゟ゠-ヿ]{2,5}",
        "postal": r"〒\d{3}[-ー]\d{4}",
        "japanese_address": r"(?:東京都|北海道|(?:大阪|京都)府|.{2,3}県).{1,6}[市区町村].{0,10}(?:\d{1,4}[-ー]\d{1,4}(?:[-ー]\d{1,4})?|[一二三四五六七八九十]+丁目)",
        "chinese_address": r"[一-鿿]{2,6}(?:省|市|区|县|镇|村|路|街|道|巷|弄|号|幢|栋|室|楼)\s*(?:[一-鿿]*(?:省|市|区|县|镇|村|路|街|道|巷|弄|号|幢|栋|室|楼)\s*){1,5}\d{0,5}",
        "labelled_address": r"(?:住所|地址)[\s:：]*[一-鿿぀-ゟ゠-ヿ\d\-ー]{5,}",
        "phone": r"(?:电话|電話|手机|手機|携帯|連絡先|联系电话)[\s:：]*[+＋]?\d[\d\s\-ー().（）]{7,18}",
    },
}
ANY_CASE = frozenset({"identifiers", "phone", "postal", "birth", "cjk"})
#: Codes of clinical documents that are no format of ``SAFE`` already, without regard to case.
CLINICAL = {
    "eudract": r"\b\d{4}-\d{6}-\d{2}\b",
    "protocol": r"\b(?:Protocol(?:\s+ID)?|Study)[\s:]*[A-Z]{2,5}[-\s]?\d{3,5}\b",
    "subject": r"\b(?:Subject|Patient|SUBJ)[\s#:-]*\d{3,}(?:[-]\d{3})?\b",
    "site": r"\b(?:Site|Center)[\s#:-]*\d{2,4}\b",
    "lot": r"\b(?:Lot|Batch|Kit)[\s:]*[A-Z0-9]{2,}[-]?[A-Z0-9]{2,}\b|(?:Sample(?:\s+ID))[\s:]*[A-Z0-9]{2,}[-]?[A-Z0-9]{2,}\b",
    "number_first": r"\b\d{2,6}[-_/][A-Z]{2,6}\b",
    "dni": r"\b\d{8}[-]?[A-Za-z]\b",
    "plate": r"\b\d{4}[\s-]?[A-Z]{2,3}\b|\b[A-Z]{1,2}[\s-]?\d{4}[\s-]?[A-Z]{2,3}\b",
    "spaced_digits": r"\b\d{2,}(?:\s\d{2,}){2,}\b",
}
#: Codes in capitals, with regard to case, and abbreviations with a value, without.
CODES = {"alphanumeric": r"\b[A-Z]{1,}\d{6,}[A-Za-z0-9]*\b|\b[A-Z]{3,}\d{5,}\b"}
WITH_VALUE = {
    "record": r"\b(?:CRN|MRN|PRN|IFU|HDD|SSN|ID|REF|NO)[-#:\s]+[A-Z0-9]{2,}[-]?\d{2,}\b",
    "numbered": r"\b(?:Protocol|Study|Subject|Patient|Site|Center|Kit|Vial)[-\s]*(?:ID|No|Number|#)?[-:\s]*[A-Z0-9]{2,}[-/]?\d{2,}\b",
    "sample": r"\bSample[-\s]+(?:ID|No|Number|#)[-:\s]*[A-Z0-9]{2,}[-/]?\d{2,}\b",
}
#: Names of hospitals and institutes, with regard to case.
HOSPITALS = {
    "hospital_of": r"\b(?:Hospital|Hosp\.?)\s+(?:Universitario|University|General|Regional|Central|Municipal|Nacional|National|Metropolitan|Memorial|Community|Children'?s|Infantil|Pedi[aá]trico|Cl[ií]nico|Teaching)\s+(?:de\s+|del\s+)?[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,3}\b",
    "name_hospital": r"\b[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\s+(?:Hospital|Medical\s+Center|Clinic|Cl[ií]nica|Krankenhaus|Klinik|Hôpital|Ospedale|Ziekenhuis|Sjukhus|Sykehus)\b",
    "centre_name": r"\b(?:Medical\s+Center|Centro\s+M[eé]dico|Centre\s+M[eé]dical|Medizinisches\s+Zentrum)\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\b",
    "clinic_name": r"\b(?:Cl[ií]nica|Clinic|Klinik)\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\b",
    "university": r"\b(?:University|Universidad|Universit[äa]t|Universit[eé])\s+(?:of\s+)?[A-ZÀ-ÿ][a-zÀ-ÿ]+(?:\s+[A-ZÀ-ÿ][a-zÀ-ÿ]+){0,2}\s+(?:Hospital|Medical\s+Center|School\s+of\s+Medicine|Faculty\s+of\s+Medicine)\b",
    "known_en": r"\b(?:NHS|VA|Veterans\s+Affairs|Kaiser|Mayo|Cleveland|Johns\s+Hopkins|Mass\s+General|MGH|Cedars[- ]Sinai|Mount\s+Sinai|NYU\s+Langone|Stanford\s+Health|UCSF|UCLA\s+Health)\b",
    "known_eu": r"\b(?:Charit[eé]|AP-HP|Karolinska|Huddinge|Sahlgrenska|Rigshospitalet|Erasmus\s+MC|UMC\s+Utrecht|LMU\s+Klinikum|Heidelberg\s+University\s+Hospital)\b",
    "institute": r"\b(?:Institut|Institute|Centro|Centre|Center)\s+(?:of\s+|de\s+|für\s+)?(?:Oncology|Oncolog[ií]a|Cancer|Cardiology|Cardiolog[ií]a|Neurology|Neurolog[ií]a|Research|Investigaci[oó]n)\s*[A-ZÀ-ÿ]?[a-zÀ-ÿ]*\b",
}
#: What must not be left after redaction.
CRITICAL = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}",
    "url": r"(?:https?://)[^\s]+",
    "clinical_id": r"\bNCT\d{8}\b",
    "eudract_id": r"\b\d{4}-\d{6}-\d{2}\b",
}

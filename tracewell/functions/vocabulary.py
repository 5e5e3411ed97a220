"""Vocabularies of relationship verbs and entity types, and the expressions that apply them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import normalize

# The canonical verbs, and the verbs and labels that stand for them.
CORE = (
    "TRANSFERRED_TO OWNS USES CONTROLS_ACCOUNT SHARED_IDENTIFIER ACCESSED_BY CONNECTED_TO IDENTIFIED_BY WORKS_FOR EMPLOYS "
    "DIRECTOR_OF MEMBER_OF AFFILIATED_WITH REGISTERED_AT LOCATED_AT STUDIED_AT USED_VEHICLE TRAVELED_WITH CALLED "
    "COMMUNICATED_WITH ASSOCIATED_WITH RELATED_TO MENTIONED_IN ISSUED_BY SIGNED_BY AUTHORIZED_BY RECOMMENDS KNOWS PART_OF "
    "SAME_AS CALLS RELATES_TO"
).split()
SYNONYMS = {
    "COMMUNICATED_WITH": "MESSAGED WHATSAPPED SMS EMAILED CHATTED_WITH TALKED_TO CONTACTED COMMUNICATED COMMUNICATED_WIT",
    "CALLED": "PHONE_CALL CALLS",
    "ASSOCIATED_WITH": "MET KNOWS_OF ACQUAINTANCE_OF FRIEND_OF SEEN_WITH LINKED_TO ASSOCIATE_OF ASSOCIATED_WIT",
    "AFFILIATED_WITH": "AFFILIATED",
    "RELATED_TO": "RELATED RELATIVE_OF FAMILY_OF BROTHER_OF SISTER_OF SON_OF DAUGHTER_OF WIFE_OF HUSBAND_OF FATHER_OF MOTHER_OF KIN_OF",
    "TRANSFERRED_TO": "TRANSFERRED_MONEY_TO SENT_MONEY_TO PAID PAID_TO TRANSFER TRANSFERRED WIRED_TO TRANSFERRED_CASH_TO TRANSFERRED_T TRANSFERRED_TO_",
    "CONTROLS_ACCOUNT": "OWNS_ACCOUNT CONTROLS CONTROLS_ACCOUN",
    "SAME_AS": "SAME_AS",
    "SHARED_IDENTIFIER": "SAME_IDENTITY",
    "PART_OF": "PART_OF",
    "MEMBER_OF": "MEMBER MEMBER_O",
    "ACCESSED_BY": "ACCESSED",
    "STUDIED_AT": "STUDIED STUDENT_OF STUDIED_A",
    "WORKS_FOR": "EMPLOYED_AT WORKS_AT EMPLOYEE_OF WORKS_FO",
    "REGISTERED_AT": "STAYS_AT RESIDES_AT LIVES_AT RESIDES_IN REGISTERED_A",
    "LOCATED_AT": "ADDRESS_OF LOCATED_IN",
    "USED_VEHICLE": "DRIVES DROVE USED_VEHICL",
    "MENTIONED_IN": "MENTIONED REFERENCES MENTIONED_I",
    "ISSUED_BY": "ISSUED",
    "SIGNED_BY": "SIGNED",
    "AUTHORIZED_BY": "AUTHORIZED",
    "DIRECTOR_OF": "DIRECTOR_O",
    "IDENTIFIED_BY": "IDENTIFIED_B",
    "TRAVELED_WITH": "TRAVELED_WIT",
}
REVERSED = {
    "TRANSFERRED_TO": "RECEIVED_FROM RECEIVED_MONEY_FROM PAID_BY",
    "OWNS": "OWNED_BY",
    "EMPLOYS": "EMPLOYED_BY EMPLOYER_OF",
    "ISSUED_BY": "ISSUED_TO",
    "DIRECTOR_OF": "DIRECTED_BY",
    "RECOMMENDS": "RECOMMENDED_BY",
}
#: Cut-off verbs that a table's literal verb never is.
TRUNCATED = (
    "TRANSFERRED_T ASSOCIATED_WIT COMMUNICATED_WI REGISTERED_A TRAVELED_WIT USED_VEHICL DIRECTOR_O MENTIONED_I MESSAGED_I"
).split()
#: Model verbs whose canonical verb differs from the table's one.
MODEL = {"TRANSFERRED_MONEY": "TRANSFERRED_TO", "WORKED_FOR": "WORKS_FOR", "MENTIONS": "MENTIONED_IN"}
TYPES = {
    "person": "PERSON PEOPLE INDIVIDUAL HUMAN SUSPECT ACCUSED WITNESS VICTIM OFFICER DIRECTOR EMPLOYEE STUDENT",
    "organization": "ORGANIZATION ORGANISATION ORG COMPANY FIRM BUSINESS ENTERPRISE ESTABLISHMENT COLLEGE UNIVERSITY INSTITUTE SCHOOL BANK TRUST NGO",
    "phone": "PHONE MOBILE PHONE_NUMBER MOBILE_NUMBER CONTACT CONTACT_NUMBER WHATSAPP CELL MSISDN TELEPHONE",
    "account": "BANK_ACCOUNT ACCOUNT ACCOUNT_NUMBER BANK_ACC A_C",
    "device": "DEVICE MOBILE_DEVICE HANDSET PHONE_DEVICE",
    "imei": "IMEI",
    "vehicle": "VEHICLE CAR AUTOMOBILE",
    "location": "ADDRESS LOCATION PLACE CITY TOWN AREA DISTRICT STATE COUNTRY LOCALITY",
    "document_id": "EVIDENCE_DOCUMENT DOCUMENT DOC EVIDENCE RECORD FILE",
    "email": "EMAIL MAIL EMAIL_ID EMAIL_ADDRESS MAIL_ADDRESS",
    "upi": "UPI VPA UPI_ID",
    "ip": "IP IP_ADDRESS",
    "url": "URL WEBSITE",
    "domain": "DOMAIN",
    "wallet": "WALLET CRYPTO_WALLET CRYPTO",
    "social": "SOCIAL SOCIAL_MEDIA HANDLE USERNAME TWITTER INSTAGRAM SOCIAL_ACCOUNT SOCIAL_PROFILE ACCOUNT_HANDLE",
    "event": "EVENT INCIDENT OCCURRENCE",
    "ifsc": "IFSC IFSC_CODE",
}


def turned(groups: dict[str, str]) -> dict[str, str]:
    """{word: the name whose words it is in}."""
    return {word: name for name, words in groups.items() for word in words.split()}


def lookup(key: Column, words: dict[str, str]) -> Column:
    """The word's value, null if it has none."""
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[key]


def relation(raw: Column) -> Column:
    """struct(type, reversed, novel, raw) of a table's verb.

    Reversed verbs come first, then canonical ones, then synonyms; another well-formed verb is kept as a new
    type, and anything else, null and empty too, is an association.
    """
    v = normalize.verb(F.coalesce(raw, F.lit("")))
    back, same, core = lookup(v, turned(REVERSED)), lookup(v, turned(SYNONYMS)), v.isin(CORE)
    novel = back.isNull() & ~core & same.isNull() & normalize.well_formed_verb(v)
    kind = F.coalesce(back, F.when(core, v), same, F.when(novel, v), F.lit("ASSOCIATED_WITH"))
    return F.struct(kind.alias("type"), (back.isNotNull() & (v != "")).alias("reversed"), (novel & (v != "")).alias("novel"), v.alias("raw"))


def model_relation(raw: Column) -> Column:
    """The same of a verb that a model wrote: canonical verbs first, then the model's own words."""
    v = normalize.verb(F.coalesce(raw, F.lit("")))
    own, table = lookup(v, MODEL), relation(raw)
    hit = v.isin(CORE) | own.isNotNull()
    return F.when(
        hit, F.struct(F.coalesce(own, v).alias("type"), F.lit(False).alias("reversed"), F.lit(False).alias("novel"), v.alias("raw"))
    ).otherwise(table)


def evidence_relation(raw: Column) -> Column:
    """The same of a verb in a table's own column: a synonym stays as it was written unless it is cut off."""
    found = relation(raw)
    literal = F.upper(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[\s-]+", "_"))
    keep = lookup(literal, turned(SYNONYMS)).isNotNull() & ~literal.isin(TRUNCATED)
    return F.when(
        keep, F.struct(literal.alias("type"), found["reversed"].alias("reversed"), F.lit(False).alias("novel"), found["raw"].alias("raw"))
    ).otherwise(found)


def entity_type(label: Column) -> Column:
    """Canonical type of a table's type label, null if it is none."""
    return lookup(F.upper(F.regexp_replace(F.trim(label), r"[\s-]+", "_")), turned(TYPES))

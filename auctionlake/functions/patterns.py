"""The regular expressions and formats that notices and feeds are read with.

They define what counts as a match, so they are stated as they are. ``U`` makes
character classes cover Unicode, as the notices contain no-break spaces. A leading ``(?=...)`` names the first characters a match can
have, so that a scan passes over others at once.
"""

MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
MONTH = "|".join(MONTHS)

ACREAGE = (
    r"(?iU)(?=[cb])(?:containing|being|consisting of|contain)\s+approximately?\s+([\d,]+(?:\.\d+)?)\s+acres?",
    r"(?iU)(?=[cb])(?:containing|being|consisting of|contain)\s+([\d,]+(?:\.\d+)?)\s+acres?",
    r"(?iU)([\d,]+(?:\.\d+)?)\s+acres?\s*(?:more or less|m\.o\.l\.)",
    r"(?iU)tract\s+(?:no\.?\s*)?\d+[^,]+?([\d,]+(?:\.\d+)?)\s+acres?",
    r"(?iU)parcel\s+(?:no\.?\s*)?\d+[^,]+?([\d,]+(?:\.\d+)?)\s+acres?",
)
#: A word without which the wording of the same place cannot match, in lower case.
ACREAGE_WORDS = ("approximate", "acre", "acre", "tract", "parcel")

PIN = (
    r"(?iU)tax\s+parcel\s*#?\s*(\d{3,}-[\d–\-?]+)",
    r"(?iU)parcel\s+ID\s*[:#]?\s*(\d{3,}-[\d–\-?]+)",
    r"(?iU)parcel\s+identification\s+number\s*[:#]?\s*((?:\d[\d–\-? ]*?))(?=\s+and\s|\s*[;,.]|\s+$)",
    r"(?iU)parcel\s*[:#]\s*(\d{3,}-[\d–\-?]+)",
    r"(?iU)parcel\s+(\d{3,}-[\d–\-?]+)",
    r"(?iU)\bPIN\s*[:#]?\s*(\d{4,}(?:-[\d–\-?]+)+|\d{12,})",
    r"(?iU)\bPID\s*[:#]?\s*(\d{3,}-[\d–\-?]+)",
    r"(?iU)\bREID\s*[:#]?\s*(\d{4,})",
)
#: Words without which the pattern of the same place cannot match, in lower case.
PIN_NEEDS = (("tax", "parcel"), ("parcel", "id"), ("parcel", "identification"), ("parcel",), ("parcel",), ("pin",), ("pid",), ("reid",))
PIN_SEPARATORS = r"(?U)[\s–?]+"

# (pattern, prefix before the first number, text between the numbers)
DEED_PLAT = (
    (r"(?U)[Dd]eed\s+(?:[Bb]ook|[Bb]k|[Vv]ol\.?|[Vv]olume)\s+(\d+)\s*,?\s*(?:at\s+)?(?:[Pp]age|[Pp]g)\.?\s+(\d+)",
     "Deed:Bk", "Pg"),
    (r"(?U)[Pp]lat\s+(?:[Bb]ook|[Bb]k)\s+(\d+)\s*,?\s*(?:at\s+)?(?:[Pp]age|[Pp]g)\.?\s+(\d+)", "Plat:Bk", "Pg"),
    (r"(?U)[Pp]lat\s+[Ff]ile\s+(\d+)\s*,?\s*(?:at\s+)?(?:[Pp]age|[Pp]g)\.?\s+(\d+)", "Plat:File", "Pg"),
    (r"(?U)[Pp]lat\s+[Cc]abinet\s+(\d+)\s*,?\s*(?:at\s+)?(?:[Ss]lide)\s+(\d+)", "Plat:Cabinet", "Slide"),
    (r"(?U)[Bb]ook\s*:?\s+(\d+)\s*,?\s*(?:at\s+)?(?:[Pp]age|[Pp]g)\.?\s*:?\s+(\d+)", "Deed:Bk", "Pg"),
)
#: Letters without which the pattern of the same place cannot match.
DEED_PLAT_NEEDS = (("eed",), ("lat",), ("lat", "ile"), ("lat", "abinet"), ("ook",))

COURT_CASE = (
    r"(?iU)(?=\d)\b(\d{2}(?:CVS|CVD|CVR|CV|SP|SPE|JT|JA|E)\d{3,6}(?:-\d{1,4})?)\b",
    r"(?iU)(?=\d)\b(\d{2}-(?:CVS|CVD|CVR|CV|SP|SPE|JT|JA|E)\d{3,6}(?:-\d{1,4})?)\b",
    r"(?iU)\b(?:Case (?:No|Number|#)\.?\s*:?\s*)(\d{2}-?[A-Z]{1,3}\d{3,6}(?:-\d{1,4})?)\b",
    r"(?iU)\b(?:In the (?:General|District) Court[^,]*,\s*)(\d{2}-?[A-Z]{1,3}\d{3,6}(?:-\d{1,4})?)\b",
)

SP_CASE = {"NC": r"\b(2[456]SP\d+[\w-]*)\b", "TN": r"\b(\d+SP\d+[-\w]*)\b"}

COUNTY_OF = r"(?iU)COUNTY\s+OF\s+([A-Z][A-Z]+)"
COUNTY_UPPER = r"(?U)(\b[A-Z][A-Z]+)\s+COUNTY\b"
COUNTY_LATE_OF = r"(?iU)late\s+of\s+([A-Za-z]+)\s+County"
COUNTY_COURT = r"(?iU)THE\s+GENERAL\s+COURT\s+OF\s+JUSTICE[^\n]*?\n\s*[A-Z]+.*?\n\s*([A-Z][A-Z]+)\s+COUNTY"
COUNTY_SLUG = r"-([a-z]+)-county-"

GRID_COUNTY = {
    "NC": (
        r"(?i)NORTH\s+CAROLINA\s*[,:]?\s*([A-Z\s]+?)\s+COUNTY",
        r"(?i)(?:SUPERIOR|DISTRICT)\s+Court\s+DIVISION\s+([A-Z][A-Za-z]+)\s+COUNTY",
        r"(?i)NORTH\s+CAROLINA[\s,]+([A-Z][A-Za-z]+)[\s,]+COUNTY",
    ),
    "TN": (
        r"(?i)TENNESSEE\s*[,:]?\s*([A-Z][A-Za-z]+)\s+COUNTY",
        r"(?i)([A-Z][A-Za-z]+)\s+COUNTY\s*[,:]?\s*TENNESSEE",
        r"(?i)(?:at\s+the\s+\w+\s+(?:door|entrance|breezeway|steps|lobby)[^,]*,\s*)([A-Z][A-Za-z]+)\s+County\s*Courthouse",
        r"(?i)([A-Z][A-Za-z]+)\s+County\s*Courthouse",
    ),
}
OFFICE_COUNTY = (r"(?iU)(\w+)\s+County\s+Tax\s+Office", r"(?iU)(\w+)\s+Tax\s+Office")

NOTICE_ADDRESS = r"(?iU)Address\s+of\s+(?:the\s+)?Property\s*:?\s*([^\n]+)"
DATE_OF_SALE = rf"(?iU)(?:Date\s+of\s+Sale|sale\s+date)\s*:?\s*({MONTH})\w*\s+(\d{{1,2}}),?\s+(\d{{4}})"
ON_DATE = rf"(?iU)(?=o)\bon\s+({MONTH})\w*\s+(\d{{1,2}}),?\s+(\d{{4}})\s+(?:at\s+\d{{1,2}}:\d{{2}}\s*[AP]M)?"
LONG_DATE = rf"(?U)(?:{MONTH})\w*\s+\d{{1,2}},?\s+\d{{4}}"

DOLLARS_WITH_CENTS = r"\$((\d{1,3}(?:,\d{3})*(?:\.\d{2}?)))"
CITY_STATE_ZIP = r"(?U)^(.+?),\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"
SLASH_DATE = r"(\d{1,2})/(\d{1,2})/(\d{4})"

STREET_SUFFIX_WORDS = (
    r"(?i)\b(ST|STREET|AVE|AVENUE|BLVD|BOULEVARD|DR|DRIVE|ROAD|RD|LANE|LN|CIR|CIRCLE|WAY|COURT|CT)\b\.?"
)

ICAL_FIELD = r"(?m)^(?:%s)(?:;[^:\r\n]*)?:.*$"
ICAL_CUSTOM = r'(?m)^X-TRUMBA-CUSTOMFIELD;NAME="%s";ID=(\d+);[^:\r\n]*?:(.*)$'
ICAL_CONTINUED = r"(?m)^X-TRUMBA-CUSTOMFIELD;FIELDVALUE;ID=(\d+)\s*->\s*(.*)$"
ICAL_CUSTOM_LINE = r"(?m)^X-TRUMBA-CUSTOMFIELD;(?:NAME|FIELDVALUE).*$"
PIN_LINKS = (r"PINN=([\d-]+)", r"pid=([\d-]+)")
EVENT_NUMBER = r"event/(\d+)"
ICAL_STAMP = r"(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(Z?)"

PARCEL_VIEWER = (
    "https://www.arcgis.com/apps/mapviewer/index.html"
    "?url=https%3A%2F%2Fservices.nconemap.gov%2Fsecure%2Frest%2Fservices%2FNC1Map_Parcels%2FMapServer%2F1"
)
MAPS_SEARCH = "https://www.google.com/maps/search/"
TOPO_ARGS = "map_action=map&base=maps.terrain"
BUNCOMBE_VIEWER = "https://gis.buncombenc.gov/buncomap/Default.aspx?PINN="

GRID_ROW = r'(?s)<tr class="(?:GridRow_WebBlue|GridAltRow_WebBlue)">(.*?)</tr>'
TABLE_ROW = r"(?is)<tr\b[^>]*>.*?</tr>"
TABLE_CELL = r"(?s)<td[^>]*>(.*?)</td>"
KEY_FIELD = r"(?i)<input[^>]*id=[\"'][^\"']*hdnPKValue[^\"']*[\"'][^>]*>"
VALUE_ATTRIBUTE = r"(?i)value=[\"']([^\"']*)[\"']"
DETAIL_LINK = r"location\.href='([^']+)'"
FAILED_PAGE_WORDS = r"sorry|error|blocked|404"

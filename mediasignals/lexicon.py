"""Fixed dictionaries and word lists.

Fixed values: everything in this file must equal the published configuration of the
monitoring rules, otherwise classifications differ.
"""

from __future__ import annotations

# --- fixed values: topic -> terms, in dictionary order (order defines array order) ---
TOPICS: dict[str, list[str]] = {
    "inversion": [
        "inversion", "invertir", "capital", "expansion", "nueva planta", "proyecto",
        "financiamiento", "fondo", "presupuesto", "credito", "deuda", "fideicomiso",
        "adquisicion", "crecimiento economico", "desarrollo economico",
    ],
    "empleo": [
        "empleo", "empleos", "trabajo", "contratacion", "despidos", "salario", "sueldo",
        "trabajadores", "sindicato", "laboral", "jornada laboral", "desempleo", "huelga",
        "vacante", "nomina", "contrato colectivo", "mano de obra",
    ],
    "industria": [
        "industria", "industrial", "manufactura", "automotriz", "planta", "fabrica",
        "acero", "mineria", "carbon", "coque", "siderurgia", "aerospacial", "ensamble",
        "produccion industrial", "zona industrial", "maquiladora",
    ],
    "comercio_exterior": [
        "exportacion", "importacion", "t-mec", "arancel", "comercio exterior", "exportar",
        "importar", "tmec", "balanza comercial", "aduana", "libre comercio",
        "deficit comercial", "superavit comercial", "norma de origen", "regla de origen",
        "barreras comerciales",
    ],
    "nearshoring": [
        "nearshoring", "relocalizacion", "deslocalizacion", "manufactura extranjera",
        "cadena de suministro", "reshoring", "friendshoring", "relocalizar",
        "inversion extranjera directa", "empresa extranjera",
    ],
    "aranceles": [
        "arancel", "tarifa", "impuesto importacion", "arancel compensatorio", "dumping",
        "medida antidumping", "seccion 232", "seccion 301", "ieepa",
        "cuota compensatoria", "guerra comercial", "barrera comercial",
        "represalia arancelaria",
    ],
    "energia": [
        "energia", "electricidad", "gas natural", "planta solar", "parque eolico", "cfe",
        "gasoducto", "refineria", "litio", "hidrogeno", "petroleo", "pemex", "nuclear",
        "termoelectrica", "renovable", "combustible", "turbina eolica",
    ],
    "infraestructura": [
        "infraestructura", "carretera", "autopista", "puerto", "aeropuerto", "ferrocarril",
        "tren", "parque industrial", "zona economica", "construccion", "obra publica",
        "viaducto", "puente", "corredor industrial", "logistica",
    ],
}

TOPIC_DESCRIPTIONS: dict[str, str] = {
    "inversion": "Inversiones, capital, expansión empresarial",
    "empleo": "Empleo, contrataciones, despidos, mercado laboral",
    "industria": "Industria, manufactura, sector automotriz",
    "comercio_exterior": "Exportaciones, importaciones, aranceles, T-MEC",
    "nearshoring": "Nearshoring, relocalización, cadena de suministro",
    "aranceles": "Aranceles, tarifas, medidas comerciales proteccionistas",
    "energia": "Energía, petróleo, CFE, Pemex, renovables",
    "infraestructura": "Infraestructura, carreteras, puertos, parques industriales",
}

TOPIC_LABELS: dict[str, str] = {
    "inversion": "Inversión",
    "energia": "Energía",
    "infraestructura": "Infraestructura",
    "empleo": "Empleo",
    "industria": "Industria",
    "comercio_exterior": "Comercio Exterior",
    "aranceles": "Aranceles",
    "nearshoring": "Nearshoring",
}

RISK_TERMS = [
    "cierre", "despidos", "arancel", "sanciones", "conflicto", "bloqueo", "recorte",
    "huelga", "crisis", "ciberataque",
]

OPPORTUNITY_TERMS = [
    "inversion", "expansion", "crecimiento", "nueva planta", "empleos", "apertura",
    "nearshoring", "desarrollo", "modernizacion",
]

# --- fixed values: geography ---
HOME_STATE = "coahuila"

STATES = [
    "aguascalientes", "baja california", "baja california sur", "campeche", "chiapas",
    "chihuahua", "coahuila", "colima", "cdmx", "ciudad de mexico", "durango",
    "guanajuato", "guerrero", "hidalgo", "jalisco", "mexico", "estado de mexico",
    "michoacan", "morelos", "nayarit", "nuevo leon", "oaxaca", "puebla", "queretaro",
    "quintana roo", "san luis potosi", "sinaloa", "sonora", "tabasco", "tamaulipas",
    "tlaxcala", "veracruz", "yucatan", "zacatecas",
]

HOME_COUNTRY = "mexico"

COUNTRIES = [
    "mexico", "estados unidos", "usa", "eeuu", "china", "canada", "alemania", "japon",
    "corea del sur", "india", "brasil", "espana", "francia", "italia", "reino unido",
]

COUNTRY_LABELS: dict[str, str] = {
    "mexico": "México",
    "estados unidos": "Estados Unidos",
    "usa": "Estados Unidos",
    "eeuu": "Estados Unidos",
    "china": "China",
    "canada": "Canadá",
    "alemania": "Alemania",
    "japon": "Japón",
    "corea del sur": "Corea del Sur",
    "india": "India",
    "brasil": "Brasil",
    "espana": "España",
    "francia": "Francia",
    "italia": "Italia",
    "reino unido": "Reino Unido",
}

KEY_COMPANY_TERMS = [
    "gm", "general motors", "ford", "stellantis", "chrysler", "tesla", "amazon",
    "walmart", "bmw", "toyota", "nissan", "honda", "volkswagen", "kia", "hyundai",
    "caterpillar", "john deere", "honeywell",
]

# --- fixed values: key companies (canonical name, sector, aliases; first alias is primary) ---
KEY_COMPANIES: list[tuple[str, str, list[str]]] = [
    ("General Motors", "automotriz", ["gm", "general motors", "g.m."]),
    ("Ford Motor Company", "automotriz", ["ford", "ford motor", "ford motors"]),
    ("Stellantis", "automotriz", ["stellantis", "chrysler", "fiat chrysler"]),
    ("Tesla", "automotriz", ["tesla", "tesla motors", "tesla inc"]),
    ("Amazon", "tecnologia", ["amazon", "amazon.com", "aws"]),
    ("Walmart", "retail", ["walmart", "wal-mart", "walmex"]),
    ("BMW", "automotriz", ["bmw", "bayerische motoren werke"]),
    ("Toyota", "automotriz", ["toyota", "toyota motor"]),
    ("Nissan", "automotriz", ["nissan", "nissan motor"]),
    ("Honda", "automotriz", ["honda", "honda motor"]),
    ("Volkswagen", "automotriz", ["volkswagen", "vw", "volks"]),
    ("Kia", "automotriz", ["kia", "kia motors"]),
    ("Hyundai", "automotriz", ["hyundai", "hyundai motor"]),
    ("Caterpillar", "maquinaria", ["caterpillar", "cat"]),
    ("John Deere", "maquinaria", ["john deere", "deere", "deere & company"]),
    ("Honeywell", "industrial", ["honeywell", "honeywell international"]),
]

# --- fixed values: municipalities by sub-region ---
MUNICIPALITIES: dict[str, list[str]] = {
    "Carbonífera": ["San Juan de Sabinas", "Juárez", "Múzquiz", "Progreso", "Sabinas"],
    "Centro": [
        "Cuatro Ciénegas", "Castaños", "San Buenaventura", "Abasolo", "Candela",
        "Escobedo", "Frontera", "Lamadrid", "Monclova", "Nadadores", "Ocampo",
        "Sacramento", "Sierra Mojada",
    ],
    "Norte": [
        "Allende", "Zaragoza", "Ciudad Acuña", "Guerrero", "Hidalgo", "Jiménez",
        "Morelos", "Nava", "Piedras Negras", "Villa Unión",
    ],
    "Sureste": ["Arteaga", "General Cepeda", "Parras", "Saltillo", "Ramos Arizpe"],
    "Laguna": ["Torreón", "Matamoros", "Francisco I. Madero", "San Pedro", "Viesca"],
}

# municipalities without a feed of their own: found through headlines only
TITLE_MUNICIPALITIES = [
    "Saltillo", "Torreón", "Matamoros", "Francisco I. Madero", "Ramos Arizpe",
    "San Pedro", "Viesca",
]

MINING_SUBREGION = "Carbonífera"
MINING_TERMS = [
    "carbon", "carbonera", "minera", "mina", "ahmsa", "altos hornos", "hulla", "coque",
    "minero", "extraccion", "yacimiento", "sabinas basin", "cuenca carbonifera",
]
MINING_LEVELS = ["estatal", "nacional"]

# --- fixed values: labels and defaults ---
SOURCE_PREFIX = "Google News - "
NO_REGION = "Sin region"
NO_TOPIC = "Sin tema"
DEFAULT_REGION = "Nacional"
UNKNOWN_LEVEL = "indeterminado"
MENTION_ROLE = "mencionado"

"""Queries on recognised text: document types and the fields of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions import text
from passplane.operators import classify, extract, mrz
from passplane.plans.derived import CODES, GIVEN, SURNAME, K, pad, type_of
from passplane.sources.tables import spread, table

#: Keywords put at a document's end by its number: none, or the first three of a type.
_PHRASES = {c: " ".join(classify.KEYWORDS[c].words[:3]) for c in CODES}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.try_element_at(F.array(*[F.lit(_PHRASES[c]) for c in CODES]), (F.col("doc_id") % 15 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "text", own).alias("text"))


def q_keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keywords of passports a document has."""
    return _documents(spark, sf_dir).select("doc_id", text.keyword_hits(F.upper("text"), classify.KEYWORDS["COL_PA"].words).alias("hits"))


def q_classify_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type of every document."""
    return classify.best_of(_documents(spark, sf_dir), ["doc_id"])


def q_classify_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type among those of one country."""
    return classify.best_of(_documents(spark, sf_dir), ["doc_id"], codes=[c for c in CODES if c.startswith("COL")])


def q_classify_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types of every document by score."""
    return classify.ranking(_documents(spark, sf_dir), ["doc_id"])


def q_type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document passes for the type of its session."""
    rows = classify.against(_documents(spark, sf_dir).withColumn("own", type_of("doc_id", 14)), ["doc_id"], "own")
    return rows.select("doc_id", "own", "own_score", classify.matches_session(F.col("own_score"), F.col("own"), F.col("best"), F.col("best_score")).alias("matches"))


def q_could_have_mrz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which a zone is looked for; every tenth has a line of one."""
    line = F.concat_ws("\n", "text", F.when(F.col("doc_id") % 10 == 0, "QZ7654321<<<<<<<<<<<<<<<<<<<<<"))
    return table(spark, sf_dir, "documents").select("doc_id", mrz.could_have_zone(F.col("doc_id") % 4 == 0, line).alias("looks"))


# Layouts of recognised texts by type, made up for this purpose. Placeholders stand for expressions that both engines read.

DAY, MONTH, YEAR = pad(f"(1 + {K} % 28)", 2), pad(f"(1 + {K} % 12)", 2), f"concat('', 1960 + {K} % 40)"
NAMES = ["ENE", "FEB", "MAR", "ABR", "MAY", "JUN", "JUL", "AGO", "SEP", "OCT", "NOV", "DIC"]
MON = f"substr('{''.join(NAMES)}', CAST(({K} % 12) * 3 + 1 AS INT), 3)"
ECU = pad(f"({K} * 7919 % 1000000007)", 10)
VALUES = {
    "n8": pad(K, 8), "n10": f"concat('1', {pad(K, 9)})", "n7": f"concat('1', {pad(K, 6)})", "ecu": ECU, "sur": SURNAME, "giv": GIVEN, "sex": f"CASE WHEN {K} % 2 = 0 THEN 'M' ELSE 'F' END", "word": f"CASE WHEN {K} % 2 = 0 THEN 'HOMBRE' ELSE 'MUJER' END",
    "d": DAY, "m": MONTH, "mon": MON, "y": YEAR, "iso": f"concat({YEAR}, '-', {MONTH}, '-', {DAY})", "letter": f"substr('ABCDEFGH', CAST({K} % 8 + 1 AS INT), 1)",
}

#: By type: the text, and the fields it shows with their values (as templates) and confidences.
LAYOUTS: dict[str, tuple[str, dict[str, tuple[str, float]]]] = {
    "COL_CC_OLD": (
        "REPUBLICA DE COLOMBIA\nNUMERO {n8}\n{sur}\nAPELLIDOS\n{giv}\nNOMBRES\nFECHA DE NACIMIENTO {d}-{mon}-{y}\nVALLE\n(DEPTO)\nLUGAR DE NACIMIENTO\n1.52 O+ {sex}\n{d}-{mon}-{y} VALLE\nFECHA Y LUGAR DE EXPEDICION\nP-1112223-44455566-{sex}-00{n7}-20150617\n",
        {"documentNumber": ("{n8}", 0.90), "apellidos": ("{sur}", 0.87), "nombres": ("{giv}", 0.87), "fechaNacimiento": ("{iso}", 0.90), "lugarNacimiento": ("VALLE", 0.80), "departamento": ("DEPTO", 0.80), "estatura": ("1.52", 0.85), "grupoSanguineo": ("O+", 0.88), "sexo": ("{sex}", 0.90), "fechaExpedicion": ("{iso}", 0.88), "lugarExpedicion": ("VALLE", 0.80), "codigoInferior": ("P-1112223-44455566-{sex}-00{n7}-20150617", 0.95), "fechaGeneracionCodigo": ("2015-06-17", 0.96), "alertaFechaExpedicion": ("DISCREPANCIA: impreso={d}-{mon}-{y} codigo=2015-06-17", 1.0)},
    ),
    "COL_CC_NEW": (
        "Apellidos NUIP {n10}\n- {sur} . a.\nNombres\n{giv}\nNacionalidad Estatura Sexo\nCOL 1.81 {sex}\nFecha de nacimiento\n{d} {mon} {y}\nG.S. A+\nLugar de nacimiento\nVALLE (ALTO)\nFecha y lugar de expedicion\n{d} {mon} {y}, VALLE\nFecha de expiracion\n{d} {mon} {y}\n",
        {"documentNumber": ("{n10}", 0.92), "apellidos": ("{sur}", 0.89), "nombres": ("{giv}", 0.89), "nacionalidad": ("COL", 0.88), "estatura": ("1.81", 0.85), "sexo": ("{sex}", 0.92), "grupoSanguineo": ("A+", 0.88), "lugarNacimiento": ("VALLE (ALTO)", 0.83), "fechaNacimiento": ("{iso}", 0.90), "fechaExpedicion": ("{iso}", 0.88), "lugarExpedicion": ("VALLE", 0.82), "fechaExpiracion": ("{iso}", 0.90)},
    ),
    "COL_PA": (
        "PASSPORT {sur} 7\nP COL BA{six}\nGiven names\n{giv} -\nNacionalidad\nCOLOMBIANA\nFecha de nacimiento\n{d} {mon}/{mon} {y}\nSexo / Sex\n{sex} VALLE ALTO COL\nPlace of\n{sex} VALLE ALTO COL\nDate of issue\n{d} {mon}/{mon} {y}\nDate of expiry\n{d} {mon}/{mon} {y}\nCC{n8}\n",
        {"apellidos": ("{sur}", 0.88), "nombres": ("{giv}", 0.88), "nacionalidad": ("COLOMBIANA", 0.85), "sexo": ("{sex}", 0.93), "lugarNacimiento": ("VALLE ALTO", 0.80), "fechaNacimiento": ("{iso}", 0.90), "fechaEmision": ("{iso}", 0.88), "fechaVencimiento": ("{iso}", 0.90), "numeroPersonal": ("{n8}", 0.85), "documentNumber": ("BA{six}", 0.93)},
    ),
    "COL_TI": (
        "NUMERO {n10}\n{sur}\nAPELLIDOS\n1\n{giv}\nNOMBRES\nFECHA DE NACIMIENTO {d}-{mon}-{y}\nVALLE\n(DEPTO)\nLUGAR DE NACIMIENTO\n{d}-{mon}-{y} B+ {sex}\nFECHA DE VENCIMIENTO G.S.RH SEXO\n{d}-{mon}-{y} VALLE\nFECHA Y LUGAR DE EXPEDICION\n",
        {"documentNumber": ("{n10}", 0.92), "nombres": ("{giv}", 0.87), "fechaNacimiento": ("{iso}", 0.90), "departamento": ("DEPTO", 0.80), "lugarNacimiento": ("VALLE", 0.82), "apellidos": ("{sur}", 0.87), "fechaVencimiento": ("{iso}", 0.90), "grupoSanguineo": ("B+", 0.88), "sexo": ("{sex}", 0.92), "fechaExpedicion": ("{iso}", 0.88), "lugarExpedicion": ("VALLE", 0.80)},
    ),
    "COL_PPT": (
        "N° PPT: {n7}\nAPELLIDOS: {sur}\nNOMBRES: {giv}\nFECHA DE NACIMIENTO: {d}/{m}/{y}\nNACIONALIDAD: VENEZUELA\nSEXO: {sex}\nFECHA DE EXPEDICION: {d}-{m}-{y}\nVIGENTE HASTA: {d}/{m}/{y}\nPASAPORTE: AB{n8}\n",
        {"documentNumber": ("{n7}", 0.92), "apellidos": ("{sur}", 0.87), "nombres": ("{giv}", 0.87), "fechaNacimiento": ("{iso}", 0.89), "nacionalidad": ("VENEZUELA", 0.85), "sexo": ("{sex}", 0.92), "fechaExpedicion": ("{iso}", 0.88), "vigencia": ("{iso}", 0.88), "documentoOrigen": ("AB{n8}", 0.80)},
    ),
    "COL_CE": (
        "RESIDENTE\nNo. {n7}\nAPELLIDOS: {sur}\nNOMBRES: {giv}\nNACIONALIDAD: VEN\nFECHA DE NACIMIENTO: {y}/{m}/{d}\nSEXO: {sex} RH: AB+\nF. EXPEDICION: {y}/{m}/{d}\nVENCE: {y}/{m}/{d}\n",
        {"tipoResidente": ("RESIDENTE", 0.92), "documentNumber": ("{n7}", 0.92), "apellidos": ("{sur}", 0.87), "nombres": ("{giv}", 0.87), "nacionalidad": ("VEN", 0.88), "fechaNacimiento": ("{iso}", 0.89), "sexo": ("{sex}", 0.92), "rh": ("AB+", 0.88), "fechaExpedicion": ("{iso}", 0.88), "fechaVencimiento": ("{iso}", 0.88)},
    ),
    "ESP_DNI_OLD": (
        "{n8}{letter}w\nAPELLIDOS\n{sur}\nNOMBRE x\n{giv} MAR\nSEXO NACIONALIDAD\n{sex} ESP\nFECHA DE NACIMIENTO\n{d} {m} {y}\nNUM SOPORTE\nQX{n8} {d} {m} {y}\nLUGAR DE NACIMIENTO\nVALLE\nPAIS\nMAR / SOL\n",
        {"documentNumber": ("{n8}{letter}", 0.90), "apellidos": ("{sur}", 0.85), "nombre": ("{giv} MAR", 0.85), "sexo": ("{sex}", 0.90), "nacionalidad": ("ESP", 0.88), "fechaNacimiento": ("{iso}", 0.88), "numSoporte": ("QX{n8}", 0.88), "fechaVigencia": ("{iso}", 0.88), "lugarNacimiento": ("VALLE", 0.78), "paisNacimiento": ("PAIS", 0.75), "hijoDe": ("MAR / SOL", 0.75)},
    ),
    "ESP_DNI_NEW": (
        "DNI {n8}{letter}\nAPELLIDOS / COGNOMS\n{sur}\nNOMBRE / NOM\n{giv}\nSEXO / SEXE NACIMIENTO / NAIXEMENT\n{sex} ESP {d} {m} {y}\nEMISION / VALIDEZ\n{d} {m} {y} {d} {m} {y}\nNUM SOPORTE\nWK{n8}\nDOMICILIO / DOMICILI\nC. ALTA 1\nVALLE\nALTO\nLUGAR DE NACIMIENTO / LLOC\nVALLE\nPAIS\nHIJO/A DE\nMAR Y SOL\nEQUIPO / EQUIP\nZ1Y2{letter}\n",
        {"documentNumber": ("{n8}{letter}", 0.96), "nombre": ("{giv}", 0.90), "sexo": ("{sex}", 0.93), "nacionalidad": ("ESP", 0.92), "fechaNacimiento": ("{iso}", 0.92), "fechaEmision": ("{iso}", 0.92), "fechaValidez": ("{iso}", 0.92), "numSoporte": ("WK{n8}", 0.92), "domicilioCalle": ("C. ALTA 1", 0.84), "domicilioCiudad": ("VALLE", 0.82), "domicilioProvincia": ("ALTO", 0.82), "ciudadNacimiento": ("VALLE", 0.87), "paisNacimiento": ("PAIS", 0.87), "hijoDe": ("MAR Y SOL", 0.88), "equipo": ("Z1Y2{letter}", 0.85), "apellidos": ("{sur}", 0.90)},
    ),
    "ECU_DNI_OLD": (
        "No. {ecu}\nAPELLIDOS Y NOMBRES\n{sur}\n{giv}\nLUGAR DE NACIMIENTO\nVALLE\nALTO\nFECHA DE NACIMIENTO {y}-{m}-{d}\nNACIONALIDAD ECUATORIANA\nSEXO {word}\nESTADO CIVIL SOLTERO\nINSTRUCCION\nSUPERIOR\nPROFESION / OCUPACION\nMAESTRO\nAPELLIDOS Y NOMBRES DEL PADRE:\n{sur} PADRE\nAPELLIDOS Y NOMBRES DE LA MADRE:\n{giv} MADRE\nLUGAR Y FECHA DE EXPEDICION:\nVALLE\n{y}-{m}-{d}\nFECHA DE EXPIRACION: {y}-{m}-{d}\nI9081V7263\n",
        {"documentNumber": ("{ecu}", 0.93), "apellidos": ("{sur}", 0.87), "nombres": ("{giv}", 0.87), "provincia": ("VALLE", 0.82), "canton": ("ALTO", 0.82), "fechaNacimiento": ("{iso}", 0.90), "nacionalidad": ("ECUATORIANA", 0.85), "estadoCivil": ("SOLTERO", 0.84), "instruccion": ("SUPERIOR", 0.80), "profesion": ("MAESTRO", 0.78), "padre": ("{sur} PADRE", 0.82), "madre": ("{giv} MADRE", 0.82), "lugarExpedicion": ("VALLE", 0.82), "fechaExpedicion": ("{iso}", 0.88), "fechaExpiracion": ("{iso}", 0.90), "codigoDactilar": ("I9081V7263", 0.85), "sexo": ("{sex}", 0.90)},
    ),
    "ECU_DNI_NEW": (
        "APELLIDOS CONDICION\n- {sur}\nNUI.{ecu}\n{sur}0.\nALTO.\nNOMBRES\n{giv}\nNACIONALIDAD\nECUATORIANA\nFECHA DE NACIMIENTO\n{d} {mon} {y}\nSEXO\n{word}\nLUGAR DE NACIMIENTO\nVALLE\nNo. DOCUMENTO\nx {n8}\nFECHA DE VENCIMIENTO\nx {d} {mon} {y}\nNAT/CAN\n765432\nESTADO CIVIL\nSOLTERO\nTIPO SANGRE O+\nI9081V7263\nDONANTE SI\n",
        {"documentNumber": ("{ecu}", 0.94), "numDocumento": ("{n8}", 0.88), "apellidos": ("{sur} ALTO", 0.85), "nombres": ("{giv}", 0.88), "nacionalidad": ("ECUATORIANA", 0.85), "lugarNacimiento": ("VALLE", 0.83), "fechaNacimiento": ("{iso}", 0.90), "fechaVencimiento": ("{iso}", 0.90), "natCan": ("765432", 0.82), "estadoCivil": ("SOLTERO", 0.84), "tipoSangre": ("O+", 0.87), "codigoDactilar": ("I9081V7263", 0.85), "donante": ("SI", 0.84), "sexo": ("{sex}", 0.90)},
    ),
    "PER_DNI_OLD": (
        "DNI {n8}+-5\nCUI\n{n8}-5\nPrimer Apelido\n{sur}\nSegundo Apellido\nALTO\nPre Nombres\n{giv}\nSexo\n{sex}\nEstado Civil\nS\nNacimiento: Fecha y Ubigeo\n{d} {m} {y} 998877\nFecha Inscripcion\n{d} {m} {y}\nFecha Emision\n{d} {m} {y}\nFecha Caducidad\n{d} {m} {y}\n",
        {"documentNumber": ("{n8}", 0.90), "cui": ("{n8}-5", 0.90), "primerApellido": ("{sur}", 0.88), "segundoApellido": ("ALTO", 0.88), "nombres": ("{giv}", 0.88), "sexo": ("{sex}", 0.93), "estadoCivil": ("S", 0.83), "fechaNacimiento": ("{iso}", 0.90), "ubigeo": ("998877", 0.85), "fechaInscripcion": ("{iso}", 0.85), "fechaEmision": ("{iso}", 0.88), "fechaCaducidad": ("{iso}", 0.90), "apellidos": ("{sur} ALTO", 0.88)},
    ),
    "PER_DNI_NEW": (
        "CUI {n8}-1\nPrimer Apellido\n{sur}\nSegundo Apellido\nALTO\nPrenombres\n{giv}\nSexo\n{sex}\nNacionalidad\nPER\nFecha de Nacimiento\n{d} {m} {y}\nEstado Civil\nSOLTERO\nFecha de Emision\n{d} {m} {y}\nFecha de Caducidad\n{d} {m} {y}\nN° de Tarjeta\n{n8}\nUbigeo de Nacimiento: 998877\nDonacion de Organos: NO\nDireccion: CALLE 1\nDepartamento/Provincia/Distrito: SUR/SUR/ALTO\n",
        {"documentNumber": ("{n8}", 0.94), "primerApellido": ("{sur}", 0.88), "segundoApellido": ("ALTO", 0.88), "nombres": ("{giv}", 0.88), "sexo": ("{sex}", 0.93), "nacionalidad": ("PER", 0.88), "estadoCivil": ("SOLTERO", 0.84), "fechaNacimiento": ("{iso}", 0.90), "fechaEmision": ("{iso}", 0.88), "fechaCaducidad": ("{iso}", 0.90), "numeroDeTarjeta": ("{n8}", 0.85), "ubigeoNacimiento": ("998877", 0.85), "donacionOrganos": ("NO", 0.83), "direccion": ("CALLE 1", 0.80), "deptoProviDist": ("SUR/SUR/ALTO", 0.82), "apellidos": ("{sur} ALTO", 0.88)},
    ),
    "PAN_DNI_OLD": (
        "4-555-{n8}\nTRIBUNAL\n{giv}\n{sur}\nNOMBRE USUAL\nFECHA DE NACIMIENTO: {d}-{mon}-{y}\nLUGAR DE NACIMIENTO: VALLE, ALTO\nSEXO: {sex} TIPO DE SANGRE: O+\nEXPEDIDA: {d}-{mon}-{y} EXPIRA: {d}-{mon}-{y}\n",
        {"documentNumber": ("4-555-{n8}", 0.90), "nombres": ("{giv}", 0.82), "apellidos": ("{sur}", 0.82), "fechaNacimiento": ("{iso}", 0.89), "lugarNacimiento": ("VALLE, ALTO", 0.83), "sexo": ("{sex}", 0.93), "tipoSangre": ("O+", 0.82), "fechaExpedicion": ("{iso}", 0.88), "fechaVencimiento": ("{iso}", 0.88)},
    ),
    "PAN_DNI_NEW": (
        "DOCUMENTO DE IDENTIDAD\n{giv}\n{sur}\n4-555-{n8}\nFECHA DE NACIMIENTO: {d}-{mon}-{y}\nLUGAR DE NACIMIENTO: VALLE, ALTO\nSEXO: {sex} TIPO DE SANGRE: O+\nEXPEDIDA: {d}-{mon}-{y} EXPIRA: {d}-{mon}-{y}\n",
        {"documentNumber": ("4-555-{n8}", 0.92), "nombres": ("{giv}", 0.82), "apellidos": ("{sur}", 0.82), "fechaNacimiento": ("{iso}", 0.89), "lugarNacimiento": ("VALLE, ALTO", 0.83), "sexo": ("{sex}", 0.93), "tipoSangre": ("O+", 0.82), "fechaExpedicion": ("{iso}", 0.88), "fechaVencimiento": ("{iso}", 0.88)},
    ),
}
VALUES["six"] = pad(K, 6)

#: What every seventh text of a type says instead: labels and codes left out or written in their other form, and the fields
#: that change by it (None: not found, else value and confidence).
VARIANTS: dict[str, tuple[list[tuple[str, str]], dict[str, tuple[str, float] | None]]] = {
    # the number comes from the code at the foot
    "COL_CC_OLD": ([("NUMERO {n8}\n", "")], {"documentNumber": ("{n7}", 0.97)}),
    # the blood group stands after the year of birth
    "COL_CC_NEW": ([("Nombres\n{giv}\n", ""), ("G.S. A+", "A+")], {"nombres": None}),
    "COL_PA": ([("PASSPORT {sur} 7", "PASS {sur} 7"), ("CC{n8}\n", "")], {"numeroPersonal": None}),
    "COL_TI": ([("{giv}\nNOMBRES\n", "{giv}\n")], {"nombres": None}),
    "COL_PPT": ([("SEXO: {sex}\n", "")], {"sexo": None}),
    "COL_CE": ([("RESIDENTE\n", "")], {"tipoResidente": None}),
    # the line before the sex is taken for the name, and the surnames run on
    "ESP_DNI_OLD": ([("NOMBRE x\n", "")], {"nombre": ("{giv} MAR", 0.75), "apellidos": ("{sur} {giv} MAR", 0.85)}),
    # a line of nine hexadecimal digits is the device
    "ESP_DNI_NEW": ([("EQUIPO / EQUIP\nZ1Y2{letter}\n", "{n8}A\n")], {"equipo": ("{n8}A", 0.85)}),
    "ECU_DNI_OLD": ([("ESTADO CIVIL SOLTERO\n", "")], {"estadoCivil": None}),
    "ECU_DNI_NEW": ([("NUI.{ecu}\n", ""), ("DONANTE SI\n", "")], {"documentNumber": None, "donante": None}),
    "PER_DNI_OLD": ([("Segundo Apellido\nALTO\n", "")], {"segundoApellido": None, "apellidos": ("{sur}", 0.88)}),
    "PER_DNI_NEW": ([("CUI {n8}-1", "DNI {n8}-1")], {"documentNumber": ("{n8}", 0.88)}),
    "PAN_DNI_OLD": ([("NOMBRE USUAL\n", "")], {"nombres": None, "apellidos": None}),
    "PAN_DNI_NEW": ([("SEXO: {sex} ", "")], {"sexo": None}),
}


def _template(template: str) -> str:
    """SQL for a template: constants and placeholders concatenated."""
    parts = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        if k % 2:
            parts.append(f"({VALUES[piece]})")
        elif piece:
            parts += ["chr(10)" if x == "\n" else f"'{x}'" for x in _lines(piece)]
    return f"concat({', '.join(parts)})"


def _lines(piece: str) -> list[str]:
    out: list[str] = []
    for k, line in enumerate(piece.split("\n")):
        out += (["\n"] if k else []) + ([line] if line else [])
    return out


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def _texts(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """(c_custkey, text): recognised texts of one type; every seventh is a variant."""
    whole = varied = LAYOUTS[code][0]
    for old, new in VARIANTS[code][0]:
        varied = varied.replace(old, new)
    return _customers(spark, sf_dir).select("c_custkey", F.expr(f"CASE WHEN {K} % 7 = 0 THEN {_template(varied)} ELSE {_template(whole)} END").alias("text"))


def _extraction(code: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = extract.extract(_texts(spark, sf_dir, code), ["c_custkey"], code)
        # alerts on check digits have a query of their own
        return found.where("field <> 'alertaDocumento'").select("c_custkey", "field", "value", "confidence")

    return query


def q_ecu_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on Ecuadorian numbers whose check fails."""
    texts = _customers(spark, sf_dir).select("c_custkey", F.expr(_template(LAYOUTS["ECU_DNI_OLD"][0])).alias("text"))
    return extract.extract(texts, ["c_custkey"], "ECU_DNI_OLD").where("field = 'alertaDocumento'").select("c_custkey", "value")


SIDES = {"FRONT": extract.FRONT_OLD, "BACK": extract.BACK_OLD, "AUTO": tuple(LAYOUTS["COL_CC_OLD"][1])}


def q_extract_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that the faces of the old Colombian card keep, and all of them where the face is not given."""
    texts = _texts(spark, sf_dir, "COL_CC_OLD")
    first, *others = [extract.extract(texts, ["c_custkey"], "COL_CC_OLD", side=side).select("c_custkey", F.lit(side).alias("side"), "field", "value") for side in SIDES]
    for other in others:
        first = first.unionByName(other)
    return first


QUERIES = {f.__name__: f for f in (q_keyword_hits, q_classify_argmax, q_classify_country, q_classify_rank, q_type_mismatch, q_could_have_mrz, q_ecu_alert, q_extract_side)}
QUERIES |= {f"q_extract_{c.lower()}": _extraction(c) for c in CODES}


def _hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(t, '{w.upper()}')::INT" for w in words) + ")"


def _score(code: str) -> str:
    k = classify.KEYWORDS[code]
    points = f"{_hits(k.words)} * {k.unit}::DOUBLE"
    if k.correction:
        points += f" + CASE WHEN {_hits(k.corrected_by)} > 0 THEN {k.correction}::DOUBLE ELSE 0.0::DOUBLE END"
    return f"least(greatest({points}, 0.0::DOUBLE), 1.0::DOUBLE)"


_PHRASE = "CASE doc_id % 15 " + " ".join(f"WHEN {k} THEN '{_PHRASES[c]}'" for k, c in enumerate(CODES)) + " END"
_UPPER = f"u AS (SELECT doc_id, upper(concat_ws(' ', text, {_PHRASE})) AS t FROM documents)"
_SCORES = f"{_UPPER}, s AS (" + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS code, {_score(c)} AS type_score FROM u" for c in CODES) + ")"


def _best(where: str = "true") -> str:
    return f"WITH {_SCORES} SELECT doc_id, CASE WHEN type_score > 0 THEN code ELSE 'UNKNOWN' END AS code, type_score FROM s WHERE {where} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY type_score DESC, code) = 1"


def _expected(code: str, fields: tuple[str, ...] | None = None, before: str = "", confidence: bool = True) -> str:
    """SQL for the fields of a type's texts: the layout's, with the changes of every seventh text."""
    out, changed = [], VARIANTS[code][1]
    for name, plain in LAYOUTS[code][1].items():
        if fields and name not in fields:
            continue
        cases = [(plain, "")] if name not in changed else [(plain, f" WHERE {K} % 7 <> 0"), (changed[name], f" WHERE {K} % 7 = 0")]
        out += [f"SELECT c_custkey, {before}'{name}' AS field, {_template(found[0])} AS value{f', {found[1]}::DOUBLE AS confidence' if confidence else ''} FROM customer{where}" for found, where in cases if found]
    return " UNION ALL ".join(out)


_OWN = "CASE doc_id % 14 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CODES)) + " END"
_ECU_D = ", ".join(f"substr(value, {i + 1}, 1)::INT AS d{i}" for i in range(10))
_ECU_SUM = " + ".join(f"(CASE WHEN d{i} * {2 - i % 2} >= 10 THEN d{i} * {2 - i % 2} - 9 ELSE d{i} * {2 - i % 2} END)" for i in range(9))

SQL = {
    "q_keyword_hits": f"WITH {_UPPER} SELECT doc_id, {_hits(classify.KEYWORDS['COL_PA'].words)}::INT AS hits FROM u",
    "q_classify_argmax": _best(),
    "q_classify_country": _best("code LIKE 'COL%'"),
    "q_classify_rank": f"WITH {_SCORES} SELECT doc_id, code, type_score, row_number() OVER (PARTITION BY doc_id ORDER BY type_score DESC, code)::INT AS rank FROM s",
    "q_type_mismatch": f"WITH {_SCORES}, o AS (SELECT *, {_OWN} AS own FROM s), b AS (SELECT doc_id, own, max(CASE WHEN code = own THEN type_score END) AS own_score, max(type_score) AS best_score FROM o GROUP BY 1, 2), w AS (SELECT doc_id, code AS best FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY type_score DESC, code) = 1) SELECT doc_id, own, own_score, own_score >= 0.30 OR best_score = 0 OR best = own OR best_score < 0.50 AS matches FROM b JOIN w USING (doc_id)",
    "q_could_have_mrz": "SELECT doc_id, doc_id % 4 = 0 OR doc_id % 10 = 0 OR regexp_matches(text, '[A-Z0-9<]{26,48}') AS looks FROM documents",
    "q_ecu_alert": f"WITH n AS (SELECT c_custkey, {ECU} AS value FROM customer), d AS (SELECT *, {_ECU_D} FROM n) SELECT c_custkey, concat('Dígito verificador inválido: ', value) AS value FROM d WHERE (10 - ({_ECU_SUM}) % 10) % 10 <> d9",
    "q_extract_side": " UNION ALL ".join(_expected("COL_CC_OLD", fields, f"'{side}' AS side, ", False) for side, fields in SIDES.items()),
}
SQL |= {f"q_extract_{c.lower()}": _expected(c) for c in CODES}

"""Fields of 14 document types from recognised text, declared as patterns and compiled to one array column per type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passplane.functions.checkdigits import ecuador_valid
from passplane.functions.registrations import add, added
from passplane.functions.text import capital_run, collapse, compound, first_group, iso_date, passport_name, sex_letter, sliced_date, strip_zeros, surname_lines


def no_dots(c: Column) -> Column:
    """Without dots."""
    return F.replace(c, F.lit("."))


def no_dots_or_spaces(c: Column) -> Column:
    """Without dots and white space."""
    return F.regexp_replace(c, r"[.\s]", "")


def no_spaces(c: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(c, r"\s", "")


def letters(c: Column) -> Column:
    """Only letters of Spanish and white space."""
    return F.trim(F.regexp_replace(c, r"[^A-ZÁÉÍÓÚÑa-záéíóúñ\s]", ""))


def plain(c: Column) -> Column:
    """As it is."""
    return c


@dataclass(frozen=True)
class Field:
    """A field: patterns in the order in which they are tried, each with its confidence, and what is done to the value.

    A pattern takes its first group, or the group given as a third element; several groups given join with a space.
    flags: of the regular expression, i unless said otherwise.
    """

    name: str
    patterns: tuple[tuple, ...]
    then: Callable[[Column], Column] = collapse
    flags: str = "i"

    def groups(self) -> list[tuple[str, int, float]]:
        """Every (pattern with flags, group) that is read, with its confidence, in order."""
        out = []
        for pattern, confidence, *group in self.patterns:
            own = f"(?{self.flags}){pattern}" if self.flags else pattern
            wanted = group[0] if group else 1
            out += [(own, g, confidence) for g in (wanted if isinstance(wanted, tuple) else (wanted,))]
        return out

    def value(self, read: list[Column]) -> tuple[Column, Column]:
        """The value and its confidence from the groups read, null where nothing matched."""
        confidences = [c for _, _, c in self.groups()]
        if len(self.patterns) == 1 and len(read) > 1:
            whole = F.concat_ws(" " if len(read) == 3 else " / ", *read)
            return self.then(F.when(read[0].isNotNull(), whole)), F.when(read[0].isNotNull(), F.lit(confidences[0]))
        return self.then(F.coalesce(*read)), F.coalesce(*[F.when(r.isNotNull(), F.lit(c)) for r, c in zip(read, confidences, strict=True)])


def one(name: str, confidence: float, pattern: str, then: Callable[[Column], Column] = collapse, flags: str = "i", group: int | tuple[int, ...] = 1) -> Field:
    """A field of one pattern."""
    return Field(name, ((pattern, confidence, group),), then, flags)


# Fixed values below: the patterns and confidences of each type's fields.

CODE = r"[APE]-\d{7}-\d{8}-[MF]-\d{7,13}-\d{8}"
CODE_NUMBER = r"[APE]-\d{7}-\d{8}-[MF]-(\d{7,13})-\d{8}"
CODE_DATE = r"[APE]-\d{7}-\d{8}-[MF]-\d{7,13}-(\d{8})"
CODE_PARTIAL = r"([APE][-\s]\d{7}[-\s]\d{8}[-\s][MF][-\s]?(\d{7,13}))"
SPACED = r"\d{2}\s\d{2}\s\d{4}"
WIDE = r"\d{2}\s+\d{2}\s+\d{4}"
NAMED = r"\d{2}\s+[A-Z]{3,4}\s+\d{4}"
SLASHED = r"\d{2}[/\-]\d{2}[/\-]\d{4}"
DASHED = r"\d{2}-[A-Z]{3}-\d{4}"
OLD_DATE = r"\d{2}-[A-Z0-9]{3,4}\.?-\d{4}"
LINE = r"([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]+?)"
ENGLISH_DATE = r"(\d{2})\s+([A-Z]{3})(?:/[A-Z]{3})?\s+(\d{4})"

COL_CC_OLD = [
    Field("documentNumber", ((r"NUMERO\s+([\d.\s]{5,22}\d)", 0.90), (r"(?m)^(\d[\d.\s]{4,20}\d)\s*\n+\s*NUMERO", 0.90)), no_dots_or_spaces),
    one("apellidos", 0.87, r"^([A-ZÁÉÍÓÚÑa-záéíóúñ][^\n]{1,50}?)\s*\n+\s*APEL\w{0,4}DOS", letters, "im"),
    one("nombres", 0.87, r"^([A-ZÁÉÍÓÚÑa-záéíóúñ][^\n]{4,50}?)\s*\n+\s*N[O0]MB?RES", letters, "im"),
    one("fechaNacimiento", 0.90, rf"FECHA\s+DE\s+NACI\w{{0,7}}O\.?\s+({OLD_DATE})"),
    one("lugarNacimiento", 0.80, r"^([A-ZÁÉÍÓÚÑa-záéíóúñ][^\n]{1,50}?)\s*\n+\s*\([^)]{2,30}\)\s*\n+[^\n]*?NACIMIENTO", flags="im"),
    one("departamento", 0.80, r"\(([A-ZÁÉÍÓÚÑa-záéíóúñ\s]{2,30})\)[^\n]*\n+[^\n]*?NACIMIENTO"),
    one("estatura", 0.85, r"(\d[,.]?\d{2})\s+[ABO0]{1,2}[+-]"),
    one("grupoSanguineo", 0.88, r"\d[,.]?\d{2}\s+([ABO0]{1,2}[+-])"),
    Field("sexo", ((r"\d[,.]?\d{2}\s+[ABO0]{1,2}[+-]\s+([MF])\b", 0.90), (r"\b([MF])\s*\n+\s*SEXO", 0.90)), F.upper),
    one("fechaExpedicion", 0.88, rf"({OLD_DATE})\s+[^\n]+\n+[^\n]*?LUGAR\s+DE\s+EXPEDICION"),
    one("lugarExpedicion", 0.80, rf"{OLD_DATE}\s+([A-ZÁÉÍÓÚÑa-záéíóúñ][^\n]{{1,50}}?)\s*\n+[^\n]*?LUGAR\s+DE\s+EXPEDICION"),
]
COL_CC_NEW = [
    one("documentNumber", 0.92, r"NUIP\s+([\d.]{6,15})", no_dots),
    one("apellidos", 0.89, r"(?:NUIP[^\n]*|\w*l+idos[^\n]*)\n([^\n]{3,60})", capital_run),
    one("nombres", 0.89, r"Nombres[^\n]*\n([^\n]{3,60})", capital_run),
    one("nacionalidad", 0.88, r"Nacionalidad[^\n]*\n\W*([A-Z]{3})\b"),
    one("estatura", 0.85, r"Estatura[^\n]*\n(?:[A-Z]{3}\s+)?(\d[.,]\d{2})"),
    one("sexo", 0.92, r"Sexo[^\n]*\n(?:[A-Z]{3}\s+)?(?:\d[.,]\d{2}\s+)?([MF])\b"),
    Field("grupoSanguineo", ((r"(?i)G\.?S\.?\s*\n?([ABO]{1,2}[+-])", 0.88), (r"\d{4}\s+([ABO][ABO]?[+-])", 0.88)), plain, ""),
    one("lugarNacimiento", 0.83, r"Lugar\s+de\s+nacimiento\s*\n([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s()]+?)\n"),
    one("fechaNacimiento", 0.90, rf"Fecha\s+de\s+nacimiento[\s\S]{{0,20}}?({NAMED})"),
    one("fechaExpedicion", 0.88, rf"Fecha\s+y\s+lugar\s+de\s+expedici[oó]n\s*\n({NAMED})"),
    one("lugarExpedicion", 0.82, rf"Fecha\s+y\s+lugar\s+de\s+expedici[oó]n\s*\n{NAMED},?\s+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s.]+?)\n"),
    one("fechaExpiracion", 0.90, rf"Fecha\s+de\s+expiraci[oó]n[^\n]*\n(?:[A-Z]{{1,3}}\s+)?({NAMED})"),
]
COL_PA = [
    one("documentNumber", 0.93, r"(?:Passport\s*N|\bCOL)\s+([A-Z]{2}\d{6})"),
    Field("apellidos", ((r"^PASSPO\w*\s+(.+?)\s*$", 0.88), (r"^PASS\s+([A-ZÁÉÍÓÚÑ].+?)\s*$", 0.88)), passport_name, "im"),
    one("nombres", 0.88, r"(?:Given\s+names?|NOMBRES)[^\n]*\n([A-ZÁÉÍÓÚÑ].+?)\s*$", passport_name, "im"),
    one("nacionalidad", 0.85, r"(?:NATIONALITY|NACIONALIDAD)[^\n]*\n+([A-ZÁÉÍÓÚÑ]{4,})"),
    one("sexo", 0.93, r"SEXO?\s*/\s*SEX[^\n]*\n\s*([MFX])\b"),
    one("lugarNacimiento", 0.80, r"(?:PLACE.OF|LUGAR\s+DE\s+NACIMIENTO)[^\n]*\n+(?:[MFX]\s+)?([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s.]{3,}?)\s+COL\b"),
    one("fechaNacimiento", 0.90, rf"(?:DATE\s+OF\s+BIRTH|FECHA\s+DE\s+NACIMIENTO)[^\n]*\n{ENGLISH_DATE}", group=(1, 2, 3)),
    one("fechaEmision", 0.88, rf"(?:DATE\s+OF\s*[ÍI]?SSU|FECHA\s+DE\s+EXPEDICI)[^\n]*\n{ENGLISH_DATE}", group=(1, 2, 3)),
    one("fechaVencimiento", 0.90, rf"(?:DATE\s+OF\s+EXPIRY|FECHA\s+DE\s+VENCIMIENTO)[^\n]*\n{ENGLISH_DATE}", group=(1, 2, 3)),
    one("numeroPersonal", 0.85, r"CC(\d{6,10})\b", plain, ""),
]
COL_TI = [
    one("documentNumber", 0.92, r"NUMERO\s+([\d.]{6,15}|\d{6}-\d{4,5})", no_dots),
    one("apellidos", 0.87, rf"^{LINE}\s*\n\s*APELLIDOS", flags="im"),
    one("nombres", 0.87, rf"^{LINE}\s*\n\s*NOMBRES", flags="im"),
    one("fechaNacimiento", 0.90, rf"FECHA\s+DE\s+NACIMIENTO\s+({DASHED})"),
    one("lugarNacimiento", 0.82, rf"^{LINE}\s*\n\s*\([^)]+\)\s*\n\s*LUGAR\s+DE\s+NACIMIENTO", flags="im"),
    one("departamento", 0.80, r"\(([A-ZÁÉÍÓÚÑ]+)\)\s*\n\s*LUGAR\s+DE\s+NACIMIENTO"),
    one("fechaVencimiento", 0.90, rf"({DASHED})\s+[ABO]{{1,2}}[+-]\s+[MF]\s*\n\s*FECHA\s+DE\s+VENCIMIENTO"),
    one("grupoSanguineo", 0.88, rf"{DASHED}\s+([ABO]{{1,2}}[+-])\s+[MF]\s*\n\s*FECHA\s+DE\s+VENCIMIENTO"),
    one("sexo", 0.92, rf"{DASHED}\s+[ABO]{{1,2}}[+-]\s+([MF])\s*\n\s*FECHA\s+DE\s+VENCIMIENTO"),
    one("fechaExpedicion", 0.88, rf"({DASHED})\s+[A-ZÁÉÍÓÚÑ]+\s*\n\s*FECHA\s+Y\s+LUGAR\s+DE\s+EXPEDICION"),
    one("lugarExpedicion", 0.80, rf"{DASHED}\s+{LINE}\s*\n\s*FECHA\s+Y\s+LUGAR\s+DE\s+EXPEDICION"),
]
COL_PPT = [
    one("documentNumber", 0.92, r"(?:N[°º\.]*\s*PPT|PERMISO.*?N[°º\.]*)[:\s]*(\d{6,12})"),
    one("apellidos", 0.87, rf"APELLIDOS?[:\s]+{LINE}(?=\n|NOMBRES?)"),
    one("nombres", 0.87, rf"NOMBRES?[:\s]+{LINE}(?=\n|FECHA|N[°º])"),
    one("fechaNacimiento", 0.89, rf"FECHA\s+DE\s+NACIMIENTO[:\s]+({SLASHED})"),
    one("nacionalidad", 0.85, r"NACIONALIDAD[:\s]+([A-ZÁÉÍÓÚÑ\s]+?)(?=\n)"),
    one("sexo", 0.92, r"SEXO[:\s]+([MF])"),
    one("fechaExpedicion", 0.88, rf"FECHA\s+DE\s+EXPEDICI[OÓ]N[:\s]+({SLASHED})"),
    one("vigencia", 0.88, rf"(?:VIGENTE\s+HASTA|VÁLIDO\s+HASTA|VIGENCIA)[:\s]+({SLASHED})"),
    one("documentoOrigen", 0.80, r"(?:DOCUMENTO\s+DE\s+ORIGEN|PASAPORTE|CÉDULA)[:\s]+([VEJ]-?\d{6,9}|[A-Z]{2}\d{6,8})"),
]
_CE_DATE = rf"(\d{{4}}/\d{{2}}/\d{{2}}|{SLASHED})"
COL_CE = [
    one("tipoResidente", 0.92, r"^(RESIDENTE|MIGRANTE|TEMPORAL|PERMANENTE)\b", flags="im"),
    one("documentNumber", 0.92, r"N[o°º\.][°º\.]*[:\s]*(\d{4,12})"),
    one("apellidos", 0.87, rf"APELLIDOS?[:\s]+{LINE}(?=\n|NOMBRES?)"),
    one("nombres", 0.87, rf"NOMBRES?[:\s]+{LINE}(?=\n|FECHA|N[o°º]|SEXO|NACION)"),
    one("nacionalidad", 0.88, r"NACIONALIDAD[:\s]+([A-Z]{2,3})"),
    one("fechaNacimiento", 0.89, rf"FECHA\s+DE\s+NACIMIENTO[:\s]+{_CE_DATE}"),
    one("sexo", 0.92, r"SEXO[:\s]+([MF])"),
    one("rh", 0.88, r"RH[:\s]+([ABO]{1,2}[+-])"),
    one("fechaExpedicion", 0.88, rf"F\.?\s*EXPEDICI[OÓ]N[:\s]+{_CE_DATE}"),
    one("fechaVencimiento", 0.88, rf"(?:VENCE|F\.?\s*VENCIMIENTO)[:\s]+{_CE_DATE}"),
]
ESP_DNI_OLD = [
    one("documentNumber", 0.90, r"\b(\d{8}[A-HJ-NP-TV-Z])"),
    one("apellidos", 0.85, r"APELLIDOS[^\n]*\n((?:[A-ZÁÉÍÓÚÑ]{2,}(?:\s[A-ZÁÉÍÓÚÑ]{2,})?\n\s*){1,2})"),
    Field("nombre", ((rf"NOMBRE[^\n]*\n{LINE}(?=\n|\.)", 0.85), (r"\n([A-ZÁÉÍÓÚÑ]{2,}\s[A-ZÁÉÍÓÚÑ]{2,})\n\s*SEXO", 0.75)), plain),
    one("sexo", 0.90, r"SEXO[^\n]*NACIONALIDAD[^\n]*\n\s*([MF])\s+[A-Z]{3}"),
    one("nacionalidad", 0.88, r"SEXO[^\n]*NACIONALIDAD[^\n]*\n\s*[MF]\s+([A-Z]{3})"),
    one("fechaNacimiento", 0.88, rf"FECHA\s+DE\s+NACIMIENTO[^\n]*\n\s*({SPACED})"),
    one("numSoporte", 0.88, rf"NUM\s+SOPORT[E]?[^\n]*\n[^\n]*?([A-Z]{{2,3}}\d{{6,9}})\s+({SPACED})", plain),
    one("fechaVigencia", 0.88, rf"NUM\s+SOPORT[E]?[^\n]*\n[^\n]*?([A-Z]{{2,3}}\d{{6,9}})\s+({SPACED})", plain, group=2),
    one("lugarNacimiento", 0.78, rf"LUGAR\s+(?:CE|DE)\s+NACIMIENTO\s*\n{LINE}\n"),
    one("paisNacimiento", 0.75, r"LUGAR\s+(?:CE|DE)\s+NACIMIENTO\s*\n[A-ZÁÉÍÓÚÑ][^\n]+\n[+\s]*([A-ZÁÉÍÓÚÑ]+)"),
    one("hijoDe", 0.75, r"([A-ZÁÉÍÓÚÑ]+)\s*/\s*([A-ZÁÉÍÓÚÑ]+)", plain, group=(1, 2)),
]
_HOME = r"DOMICILIO(?:\s*/\s*DOMICILI)?\s*\n"
_BORN = r"LUGAR\s+DE\s+NACIMIENTO(?:\s*/\s*LLOC[^\n]*)?\s*\n"
_ISSUED = r"EMISI[OÓ]N(?:\s*/\s*EMISS[IÍ]O)?[\s\S]{0,80}?\n"
_SEX_ROW = r"SEXO(?:\s*/\s*SEXE)?[\s\S]{0,80}?\n"
ESP_DNI_NEW = [
    one("documentNumber", 0.96, r"DNI[\s:]*(\d{8}[A-HJ-NP-TV-Z])"),
    one("apellidos", 0.90, r"APELLIDOS?(?:\s*/\s*COGNOMS?)?\s*\n((?:[A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s]*\n?){1,3})(?=\s*NOMBRE|\s*NOM\b)", flags="im"),
    one("nombre", 0.90, rf"NOMBRE(?:\s*/\s*NOM)?\s*\n{LINE}\n", plain),
    one("sexo", 0.93, rf"{_SEX_ROW}([MF])\s+[A-Z]{{2,3}}\s+{SPACED}"),
    one("nacionalidad", 0.92, rf"{_SEX_ROW}[MF]\s+([A-Z]{{3}})\s+{SPACED}"),
    one("fechaNacimiento", 0.92, rf"NACIMIENTO(?:\s*/\s*NAIXEMENT)?[\s\S]{{0,80}}?\n[MF]\s+[A-Z]{{3}}\s+({SPACED})"),
    one("fechaEmision", 0.92, rf"{_ISSUED}({SPACED})\s+{SPACED}"),
    one("fechaValidez", 0.92, rf"{_ISSUED}{SPACED}\s+({SPACED})"),
    one("numSoporte", 0.92, r"NUM\s+SOPORTE\s*\n([A-Z]{0,3}\d{6,9})"),
    one("domicilioCalle", 0.84, rf"{_HOME}([^\n]+)", plain),
    one("domicilioCiudad", 0.82, rf"{_HOME}[^\n]+\n{LINE}\n", plain),
    one("domicilioProvincia", 0.82, rf"{_HOME}[^\n]+\n[A-ZÁÉÍÓÚÑ][^\n]+\n{LINE}\n", plain),
    one("ciudadNacimiento", 0.87, rf"{_BORN}{LINE}\n", plain),
    one("paisNacimiento", 0.87, rf"{_BORN}[A-ZÁÉÍÓÚÑ][^\n]+\n{LINE}\n", plain),
    one("hijoDe", 0.88, r"HIJO/?A?\s+DE(?:\s*/\s*FILL/?A?\s+DE)?\s*\n([A-ZÁÉÍÓÚÑ][^\n]+)", plain),
    Field("equipo", ((r"(?:EQUIPO(?:\s*/\s*EQUIP)?\s*\n([\w]+))|(?:^([0-9A-F]{9})$)", 0.85, 1), (r"(?:EQUIPO(?:\s*/\s*EQUIP)?\s*\n([\w]+))|(?:^([0-9A-F]{9})$)", 0.85, 2)), plain, "im"),
]
_ISSUE_EC = r"LUGAR\s+Y\s+FECHA\s+DE\s+EXPEDICI[OÓ]N[:\s]*\n"
_FATHER = rf"APELLIDOS\s+Y\s+NOMBRES\s+DEL\s+PADRE[:\s]+\n?{LINE}\n"
_MOTHER = rf"APELLIDOS\s+Y\s+NOMBRES\s+DE\s+LA\s+MADRE[:\s]+\n?{LINE}\n"
_PRINT = r"([VIC]\d{4}[VIC]\d{4})"
ECU_DNI_OLD = [
    one("documentNumber", 0.93, r"No\.?\s+(\d{10})"),
    one("apellidos", 0.87, rf"APELLIDOS\s+Y\s+NOMBRES\s*\n{LINE}\n"),
    one("nombres", 0.87, rf"APELLIDOS\s+Y\s+NOMBRES\s*\n[A-ZÁÉÍÓÚÑ][^\n]+\n{LINE}\n"),
    one("provincia", 0.82, rf"LUGAR\s+DE\s+NACIMIENTO\s*\n{LINE}\n"),
    one("canton", 0.82, rf"LUGAR\s+DE\s+NACIMIENTO\s*\n[^\n]+\n{LINE}\n"),
    one("fechaNacimiento", 0.90, r"FECHA\s+DE\s+NACIMIENTO\s+(\d{4}-\d{2}-\d{2})"),
    one("nacionalidad", 0.85, r"NACIONALIDAD\s+([A-ZÁÉÍÓÚÑ]+?)(?=\n|SEXO)"),
    one("estadoCivil", 0.84, r"ESTADO\s+CIVIL\s+([A-ZÁÉÍÓÚÑ]+?)(?=\n)"),
    one("instruccion", 0.80, r"^INSTRUCCI[OÓ]N\s*\n([A-ZÁÉÍÓÚÑ]+?)(?=\n)", flags="im"),
    one("profesion", 0.78, r"PROFESI[OÓ]N\s*/\s*OCUPACI[OÓ]N\s*\n([A-ZÁÉÍÓÚÑ\s]+?)(?=\n)"),
    one("padre", 0.82, _FATHER),
    one("madre", 0.82, _MOTHER),
    one("lugarExpedicion", 0.82, rf"{_ISSUE_EC}([A-ZÁÉÍÓÚÑ]+)\n"),
    one("fechaExpedicion", 0.88, rf"{_ISSUE_EC}[A-ZÁÉÍÓÚÑ]+\n(\d{{4}}-\d{{2}}-\d{{2}})"),
    one("fechaExpiracion", 0.90, r"FECHA\s+DE\s+EXPIRACI[OÓ]N[:\s]*(\d{4}-\d{2}-\d{2})"),
    one("codigoDactilar", 0.85, _PRINT),
    one("sexo", 0.90, r"SEXO\s+(HOMBRE|MUJER|M|F)", sex_letter),
]
ECU_DNI_NEW = [
    one("documentNumber", 0.94, r"NUI[.\s]+(\d{10})"),
    one("numDocumento", 0.88, r"No\.?\s+DOCUMENTO[^\n]*\n[^\n]*?(\d{6,10})\b"),
    one("apellidos", 0.85, r"APELLIDOS[^\n]*\n([\s\S]{1,80}?)NOMBRES", surname_lines),
    one("nombres", 0.88, rf"NOMBRES\s*\n{LINE}\.?(?=\n)"),
    one("nacionalidad", 0.85, r"NACIONALIDAD\s*\n([A-ZÁÉÍÓÚÑ]+?)\n"),
    one("lugarNacimiento", 0.83, rf"LUGAR\s+DE\s+NACIMIENTO\s*\n{LINE}\n"),
    one("fechaNacimiento", 0.90, rf"FECHA\s+DE\s+NACIMIENTO\s*\n({NAMED})"),
    one("fechaVencimiento", 0.90, rf"FECHA\s+DE\s+VENCIMIENTO[^\n]*\n[^\n]*?({NAMED})"),
    one("natCan", 0.82, r"NAT/CAN\s*\n?(\d{6})"),
    one("padre", 0.82, _FATHER),
    one("madre", 0.82, _MOTHER),
    one("estadoCivil", 0.84, r"ESTADO\s+CIVIL\s*\n?([A-ZÁÉÍÓÚÑ]+?)(?=\n)"),
    one("tipoSangre", 0.87, r"TIPO\s+SANGRE\s+([ABO]{1,2}[+-])"),
    one("codigoDactilar", 0.85, _PRINT),
    one("donante", 0.84, r"DONANTE\s+(S[Ii]|NO)"),
    one("sexo", 0.90, r"SEXO\s*\n?(HOMBRE|MUJER|M|F)(?=\s|\n|$)", sex_letter),
]
_BIRTH_PE = r"Nacimiento[:\s]+Fecha\s+[yY](?:\s+Ubigeo)?\s*\n"
PER_DNI_OLD = [
    one("documentNumber", 0.90, r"DNI\s+(\d{1,2}\s?\d{6,8})[+-]*-?\d?", no_spaces),
    one("cui", 0.90, r"CUI\s*\n?(\d{8}-\d)"),
    one("primerApellido", 0.88, r"Primer\s+Ap[ae]?[lt]?ido\s*\n(?:[^\n]*\n){0,2}?([A-ZÁÉÍÓÚÑ]{3,}(?:\s[A-ZÁÉÍÓÚÑ]{3,})?)\n"),
    one("segundoApellido", 0.88, r"Segundo\s+[A-Za-zÁÉÍÓÚáéíóú]*ido\s*\n(?:[^\n]*\n){0,2}?([A-ZÁÉÍÓÚÑ]{3,})\n"),
    one("nombres", 0.88, rf"Pre\s+Nombres\s*\n{LINE}\n"),
    one("sexo", 0.93, r"Sexo[^\n]*\n(?:[^\n]*\n){0,1}?.*?\b([MF])\b"),
    one("estadoCivil", 0.83, r"Estado\s+Civil[^\n]*\n(?:[^\n]*\n){0,1}?.*?\b([SCDV])\b"),
    one("fechaNacimiento", 0.90, rf"{_BIRTH_PE}({WIDE})"),
    one("ubigeo", 0.85, rf"{_BIRTH_PE}{WIDE}\s+(\d{{6}})"),
    one("fechaInscripcion", 0.85, rf"Fecha\s+Inscripci[oó]n[\s\S]{{0,30}}?({WIDE})"),
    one("fechaEmision", 0.88, rf"Fecha\s+Emisi[oó]n[\s\S]{{0,30}}?({WIDE})"),
    one("fechaCaducidad", 0.90, rf"Fecha\s+Caducidad[\s\S]{{0,30}}?({WIDE})"),
]
PER_DNI_NEW = [
    Field("documentNumber", ((r"CUI\s*(\d{8})-\d", 0.94), (r"DNI\s+(\d{8})(?:-\d)?", 0.88))),
    one("primerApellido", 0.88, rf"Primer\s+Apellido\s*\n{LINE}\n"),
    one("segundoApellido", 0.88, rf"Segundo\s+Apellido\s*\n{LINE}\n"),
    one("nombres", 0.88, rf"Prenombres\s*\n{LINE}\n"),
    one("sexo", 0.93, r"Sexo\s*\n?([MF])(?=\s|\n)"),
    one("nacionalidad", 0.88, r"Nacionalidad\s*\n?([A-Z]{3})(?=\s|\n)"),
    one("estadoCivil", 0.84, r"Estado\s+Civil\s*\n([A-ZÁÉÍÓÚÑ]+?)(?=\n|Fecha)"),
    one("fechaNacimiento", 0.90, rf"Fecha\s+de\s+Nacimiento\s*\n?({WIDE})"),
    one("fechaEmision", 0.88, rf"Fecha\s+de\s+Emisi[oó]n\s*\n?({WIDE})"),
    one("fechaCaducidad", 0.90, rf"Fecha\s+de\s+Caducidad\s*\n?({WIDE})"),
    one("numeroDeTarjeta", 0.85, r"N[°º]\.?\s+de\s+Tarjeta\s*\n?(\d{8,12})"),
    one("ubigeoNacimiento", 0.85, r"Ubigeo\s+de\s+Nacimiento[:\s]*(\d{6})"),
    one("donacionOrganos", 0.83, r"Donaci[oó]n\s+de\s+[OÓ]rganos[:\s]+(S[Ii]|NO)"),
    one("direccion", 0.80, r"Direcci[oó]n[:\s]+([A-ZÁÉÍÓÚÑ0-9][^\n]+?)(?=\n)"),
    one("deptoProviDist", 0.82, r"Departamento/Provincia/Distrito[:\s]+([A-ZÁÉÍÓÚÑ/]+?)(?=\n)"),
]
_ID_PA = r"\b([0-9NE][A-Z0-9]*(?:-[A-Z0-9]+){1,3})\b(?=\s*\n|\s*$)"
_USUAL = r"([A-Za-zÁÉÍÓÚÑáéíóúñ][a-záéíóúñA-ZÁÉÍÓÚÑ ]+?)\n([A-Za-zÁÉÍÓÚÑáéíóúñ][a-záéíóúñA-ZÁÉÍÓÚÑ ]+?)\n[\s]*NOMBRE\s+USUAL"
_TWO_LINES = r"DOCUMENTO\s+DE\s+IDENTIDAD[\s\S]*?\n([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ\s]+?)\n([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ\s]+?)\n"


def _panama(number: float, names: str, month: str) -> list[Field]:
    date = rf"(\d{{2}}-{month}-\d{{4}})"
    return [
        one("documentNumber", number, _ID_PA, flags="im"),
        one("nombres", 0.82, names, plain),
        one("apellidos", 0.82, names, plain, group=2),
        one("fechaNacimiento", 0.89, rf"FECHA\s+DE\s+NACIMIENTO[:\s]+{date}"),
        one("lugarNacimiento", 0.83, r"LUGAR\s+DE\s+NACIMIENTO[:\s]+([A-ZÁÉÍÓÚÑ][A-ZÁÉÍÓÚÑ\s,]+?)(?=\n)"),
        one("sexo", 0.93, r"SEXO[:\s]+([MF])"),
        one("tipoSangre", 0.82, r"TIPO\s+DE\s+SANGRE[:\s]+([ABO]{1,2}[+-])"),
        one("fechaExpedicion", 0.88, rf"EXPEDIDA[:\s]+{date}"),
        one("fechaVencimiento", 0.88, rf"EXPIRA[:\s]+{date}"),
    ]


FIELDS = {
    "COL_CC_OLD": COL_CC_OLD, "COL_CC_NEW": COL_CC_NEW, "COL_PA": COL_PA, "COL_TI": COL_TI, "COL_PPT": COL_PPT, "COL_CE": COL_CE,
    "ESP_DNI_OLD": ESP_DNI_OLD, "ESP_DNI_NEW": ESP_DNI_NEW, "ECU_DNI_OLD": ECU_DNI_OLD, "ECU_DNI_NEW": ECU_DNI_NEW,
    "PER_DNI_OLD": PER_DNI_OLD, "PER_DNI_NEW": PER_DNI_NEW, "PAN_DNI_OLD": _panama(0.90, _USUAL, "[A-Z]{3}"), "PAN_DNI_NEW": _panama(0.92, _TWO_LINES, "[A-Za-z]{3,4}"),
}

#: What the faces of the old Colombian card keep.
FRONT_OLD = ("documentNumber", "apellidos", "nombres")
BACK_OLD = ("fechaNacimiento", "lugarNacimiento", "departamento", "estatura", "grupoSanguineo", "sexo", "fechaExpedicion", "lugarExpedicion", "documentNumber", "codigoInferior", "fechaGeneracionCodigo", "alertaFechaExpedicion")


#: Further groups that derived fields need, by type.
_FOOT = {"foot": f"(?i)({CODE})", "foot_number": f"(?i){CODE_NUMBER}", "foot_date": f"(?i){CODE_DATE}"}
_EXTRA = {
    "COL_CC_OLD": {**{k: (p, 1) for k, p in _FOOT.items()}, "partial": (f"(?i){CODE_PARTIAL}", 1), "partial_number": (f"(?i){CODE_PARTIAL}", 2), "printed": (rf"(?i)({OLD_DATE})\s+[^\n]+\n+[^\n]*?LUGAR\s+DE\s+EXPEDICION", 1)},
    "COL_CC_NEW": {k: (p, 1) for k, p in _FOOT.items()},
    "COL_TI": {k: (p, 1) for k, p in _FOOT.items()},
}


def _derived(code: str) -> list[tuple[str, Column, Column]]:
    """Fields that follow from others (columns v_<name>) or from the printed code at the foot of Colombian cards (x_<name>)."""
    x, v = (lambda n: F.col(f"x_{n}")), (lambda n: F.col(f"v_{n}"))
    when = lambda value, confidence: F.when(value.isNotNull(), F.lit(confidence))
    if code in _EXTRA:
        dated = F.when(x("foot").isNotNull(), sliced_date(x("foot_date")))
        out = [("fechaGeneracionCodigo", dated, when(dated, 0.96))]
        if code != "COL_CC_OLD":
            return [("codigoInferior", x("foot"), when(x("foot"), 0.95)), *out]
        out.append(("codigoInferior", F.coalesce(x("foot"), x("partial")), F.when(x("foot").isNotNull(), 0.95).otherwise(0.60)))
        number = strip_zeros(F.when(x("foot").isNotNull(), x("foot_number")).otherwise(x("partial_number")), keep_all_zero=False)
        out.append(("documentNumber", F.when(v("documentNumber").isNull(), number), F.when(x("foot").isNotNull(), 0.97).otherwise(0.60)))
        # the alert compares the date as it is printed with the code's
        alert = F.when(collapse(x("printed")) != dated, F.concat(F.lit("DISCREPANCIA: impreso="), collapse(x("printed")), F.lit(" codigo="), dated))
        return [*out, ("alertaFechaExpedicion", alert, F.lit(1.0))]
    if code.startswith("ECU"):
        number = v("documentNumber")
        return [("alertaDocumento", F.when(number.isNotNull() & ~ecuador_valid(number), F.concat(F.lit("Dígito verificador inválido: "), number)), F.lit(1.0))]
    if code.startswith("PER"):
        return [("apellidos", compound(v("primerApellido"), v("segundoApellido")), F.lit(0.88))]
    return []


def extract(texts: DataFrame, keys: list[str], code: str, text: str = "text", side: str = "AUTO") -> DataFrame:
    """(keys, field, value, confidence, ord) of the fields of one type that match; no shuffle.

    Groups, values and dates are columns of their own, one step after the other, so that no expression is copied. side:
    what the faces of the old Colombian card keep.
    """
    specs = (FIELDS | added(texts.sparkSession, "fields"))[code]
    c = F.col(text)
    groups = {f"g_{f.name}_{k}": first_group(c, p, g) for f in specs for k, (p, g, _) in enumerate(f.groups())}
    extra = {f"x_{n}": first_group(c, p, g) for n, (p, g) in _EXTRA.get(code, {}).items()}
    rows = texts.select(*keys, *[e.alias(n) for n, e in (groups | extra).items()])
    got = {f.name: f.value([F.col(f"g_{f.name}_{k}") for k in range(len(f.groups()))]) for f in specs}
    rows = rows.select(*keys, *extra, *[v.alias(f"v_{n}") for n, (v, _) in got.items()], *[k.alias(f"c_{n}") for n, (_, k) in got.items()])
    dates = [f.name for f in specs if f.name.startswith("fecha") or f.name == "vigencia"]
    rows = rows.withColumns({f"v_{n}": iso_date(F.col(f"v_{n}")) for n in dates})
    every = [*((n, F.col(f"v_{n}"), F.col(f"c_{n}")) for n in got), *_derived(code)]
    if code == "COL_CC_OLD" and side != "AUTO":
        every = [x for x in every if x[0] in (FRONT_OLD if side == "FRONT" else BACK_OLD)]
    each = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value"), k.cast("double").alias("confidence"), F.lit(at).alias("ord")) for at, (n, v, k) in enumerate(every)])
    # blank values are left out, as in the contract
    return rows.select(*keys, F.inline(F.filter(each, lambda x: F.trim(x["value"]) != "")))


def register(code: str, fields: list[Field], spark: SparkSession | None = None) -> None:
    """Makes the fields of another document type known to a session (the active one, if none is given); a known code is refused."""
    add(spark, "fields", FIELDS, code, fields)

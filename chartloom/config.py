"""Fixed values and tunable limits, kept as plain data.

Everything in the first part has to equal the values the clinical documents and
their consumers already use; the second part is configuration with defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------

EXAM_KEYS = (
    "fundus_retinography",
    "iol_calculation",
    "pentacam_corneal_tomography",
    "specular_microscopy",
)

EXAM_LABELS = {
    "fundus_retinography": "Retinografia de fundo de olho",
    "iol_calculation": "Cálculo de lente intraocular",
    "pentacam_corneal_tomography": "Tomografia corneana Pentacam",
    "specular_microscopy": "Microscopia especular",
}

ALLOWED_TYPES = (
    "application/pdf",
    "application/msword",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.ms-excel",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "image/jpeg",
    "image/png",
)

EYES = ("OD", "OS")

MARKER_NAME = "paciente_compilado.json"
DRAFT_MARKER_NAME = "intake.json"

# Paths that count as "a number is present" when deciding on a repair pass.
REPAIR_PATHS = {
    "thinnest_um": (
        "pachymetry.thinnest_um",
        "pachymetry.point_and_finest_um",
        "general.thinnest_pachy_um",
        "general.pachymetry_thinnest_um",
    ),
    "kmax_d": (
        "anterior_cornea.kmax_d",
        "pachymetry.k_max_anterior_diopters",
        "general.k_max_anterior_diopters",
    ),
    "bad_d": (
        "belin_ambrosio.d",
        "ectasia_reforcada_belin_ambrosio.d",
    ),
    "art_max": (
        "belin_ambrosio.art_max",
        "belin_ambrosio.indice_de_progressao.art_max",
        "ectasia_reforcada_belin_ambrosio.art_max",
        "ectasia_reforcada_belin_ambrosio.indice_de_progressao.art_max",
    ),
}

# Fallback chains of the normalizer, first non-null wins.  "object:path" reads
# from the object named before the colon.  Deliberately not shared with
# REPAIR_PATHS: the two lists differ.
NORMALIZE_OBJECTS = {
    "ectasia": ("cornea:belin_ambrosio", "cornea:ectasia_reforcada_belin_ambrosio"),
    "topometric": ("cornea:topometric_indices_8mm", "cornea:indices_zona_8mm"),
    "cataract": ("cornea:cataract_preop", "cornea:cataract_pre_op"),
    "zernike": ("cornea:corneal_rings.zernike",),
}

NORMALIZE_NUMBERS = {
    "thinnest_um": (
        "cornea:pachymetry.thinnest_um",
        "cornea:pachymetry.point_and_finest_um",
        "cornea:general.thinnest_pachy_um",
        "cornea:general.pachymetry_thinnest_um",
        "cornea:display_maps.belin_ambrósio.thinnest_pachy_um",
        "ectasia:pachy_ponto_fino_um",
    ),
    "kmax_d": (
        "cornea:anterior_cornea.kmax_d",
        "cornea:pachymetry.k_max_anterior_diopters",
        "cornea:general.k_max_anterior_diopters",
    ),
    "bad_d": ("ectasia:d",),
    "art_max": ("ectasia:art_max", "ectasia:indice_de_progressao.art_max"),
    "z40_6mm_um": ("cataract:total_corneal_z40_6mm_um",),
    "axial_length_mm": ("biometry:axial_length_mm", "biometry:biometry.al_mm"),
    "cell_density_cells_per_mm2": (
        "endothelium:cell_density_cells_per_mm2",
        "endothelium:cell_density_cells_mm2",
    ),
}

QUALITY_PATHS = ("cornea:quality", "cornea:general.quality")
COMA_TEXT_PATH = "zernike:5mm.z31_coma"
COMA_FALLBACK_PATHS = (
    "cornea:display_maps.corneal_rings.zernike_total_corneal_wfa_5mm.z31_coma_um",
    "cornea:anéis_corneanos.total_corneal_wfa_components_of_zernike.diam_zone_5_mm.z31_coma_um",
)
ASTIGMATISM_PATHS = ("biometry:keratometry.astigmatism_d", "biometry:anterior_cornea.astig_diopters")
ASTIGMATISM_TEXT_PATH = "biometry:anterior_cornea.ast_d_deg"
TKC_PATH = "topometric:tkc"

# Report rows per eye: metric column, short name, full name, unit, screen, field.
METRIC_CATALOG = (
    ("thinnest_um", "Paquimetria mínima", None, "µm", "Pachymetry", "Thinnest"),
    ("kmax_d", "Kmax", "Ceratometria máxima", "D", "Topometric", "Kmax"),
    ("bad_d", "BAD-D", "Belin/Ambrósio Enhanced Ectasia Display", None, "Belin/Ambrósio", "Final D"),
    ("art_max", "ARTmax", "Ambrósio Relational Thickness máximo", None, "Belin/Ambrósio", "ARTmax"),
    (
        "cell_density_cells_per_mm2",
        "Celularidade endotelial",
        "Densidade celular endotelial",
        "células/mm²",
        "NIDEK",
        "Cell Density (CD)",
    ),
    ("axial_length_mm", "Comprimento axial", None, "mm", "EyeSuite IOL", "Axial length"),
)
AXIAL_LENGTH_DOCUMENT = "BIO SRK-T AO.pdf"

QUALITY_MISSING = "Não informado"
VALUE_MISSING = "não informado"
PATIENT_MISSING = "Paciente não identificado"
FILE_SUMMARY_FALLBACK = "Arquivo processado"
KIND_RAW = "Dado bruto"
KIND_MISSING = "Dado ausente"
CONFIDENT = "Consistente"
SUSPECT = "Suspeita — revisar"
STATUS_PROCESSED = "Processado"
STATUS_ATTENTION = "Atenção"
STATUS_NOT_SENT = "Não enviado"
REPORT_DONE = "Gerado"
REPORT_BLOCKED = "Bloqueado"
REVIEW_PENDING = "Pendente"
TORIC = "LIO multifocal tórica ou EDOF tórica"
NON_TORIC = "LIO multifocal ou EDOF não tórica"
TORIC_WORD = "tórica"
NON_TORIC_WORD = "não tórica"
BELOW_CUTOFF = "Registrar ponto de atenção"
ABOVE_CUTOFF = "Celularidade adequada"
BRANCH_CHOSEN = "Selecionado"
BRANCH_NOT_CHOSEN = "Não escolhido"
METRIC_CARDS = (
    ("Arquivos recebidos", "Todos disponíveis para revisão"),
    ("Dados em destaque", "Parâmetros reais de OD e OE"),
    ("Qualidade Pentacam", "OD / OE"),
    ("Consolidação", "Datas normalizadas"),
)
CONSOLIDATION_VALUE = "Compatível"

# --- configuration ----------------------------------------------------------

MIB = 1024 * 1024


@dataclass(frozen=True)
class Limits:
    """Byte bounds of an upload and of the documents read back."""

    max_file: int = 20 * MIB
    max_set: int = 50 * MIB
    max_document: int = 5 * MIB
    max_response: int = 10 * MIB

    @property
    def max_body(self) -> int:
        """Upper bound of one whole upload: files, one document and 1 MiB of framing."""
        return self.max_set + self.max_document + MIB


@dataclass(frozen=True)
class Thresholds:
    """Cut-offs of the decision-support rules."""

    toric_min_d: float = 0.75
    endothelial_cutoff: float = 2000.0
    age_young_below: int = 40
    age_senior_above: int = 55
    draft_ttl_hours: int = 24
    astigmatism_reason_d: float = 1.0
    acd_tolerance_um: float = 10.0


DEFAULT_SCHEMA_VERSION = "1.0"
DEFAULT_LANGUAGE = "pt-BR"

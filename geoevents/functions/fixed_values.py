"""Names, weights, word patterns and thresholds that results depend on.

They are data, not logic: every number or text here must keep its value for results to match.
"""

# --- city bounding box, inclusive (lat_min, lat_max, lon_min, lon_max) -------------------
CITY_BBOX = (-23.2, -22.7, -43.9, -43.0)
CITY_BBOX_WIDE = (-23.2, -22.6, -43.9, -43.0)
CITY_BBOX_NARROW = (-23.1, -22.7, -43.8, -43.0)

# --- distances in metres ------------------------------------------------------------------
CAMERA_RADIUS_M = 50.0
GAP_EPS_M = 60.0
SNAP_TOLERANCE_M = 120.0
BINGO_RADIUS_M = 100.0
RING_BUFFER_M = 500.0
ENDPOINT_SNAP_M = 12.0
MIN_COMPONENT_EDGES = 150

# --- offences -----------------------------------------------------------------------------
ROBBERY_PASSERBY = "Roubo a transeunte"
ROBBERY_PHONE = "Roubo de aparelho celular"
ROBBERY_BUS = "Roubo em coletivo"
GAP_SEVERITY = {ROBBERY_PASSERBY: 1.0, ROBBERY_PHONE: 1.0, ROBBERY_BUS: 1.3}
GAP_SEVERITY_DEFAULT = 1.0

# kind -> words of which one must occur in the lower-case description
KIND_WORDS = {
    "transeunte": ["transeunte"],
    "celular": ["celular", "aparelho"],
    "coletivo": ["coletivo"],
}

OFFENCE_TYPES = {
    "roubo a transeunte": "roubo_transeunte",
    "roubo de veiculo": "roubo_veiculo",
    "roubo de veículo": "roubo_veiculo",
    "roubo em coletivo": "roubo_transporte_coletivo",
    "roubo em transp coletivos": "roubo_transporte_coletivo",
    "roubo a estabelecimento": "roubo_estabelecimento",
    "roubo a residencia": "roubo_residencia",
    "roubo a residência": "roubo_residencia",
    "roubo de carga": "roubo_carga",
    "furto a transeunte": "furto",
    "furto de veiculo": "furto_veiculo",
    "furto de veículo": "furto_veiculo",
    "furto": "furto",
    "sequestro relampago": "sequestro_relampago",
    "sequestro relâmpago": "sequestro_relampago",
}

# --- modus operandi tags, in output order ---------------------------------------------------
MODUS_PATTERNS = {
    "a_pe": [r"\ba p[eé]\b", r"\bcaminhando\b", r"\btranseunte"],
    "motocicleta": [r"\bmoto\b", r"\bmotocicleta", r"\bduas rodas"],
    "bicicleta": [r"\bbicicleta", r"\bciclista"],
    "armado": [r"\barma de fogo", r"\bpistola", r"\brevolver", r"\barmados?\b"],
    "arma_branca": [r"\bfaca\b", r"\bcanivete", r"\barma branca"],
    "em_grupo": [r"\bgrupo\b", r"\bdois indiv", r"\btr[ée]s indiv", r"\bquatro indiv", r"\bbando"],
    "menores": [r"\bmenores?\b", r"\badolescentes?\b"],
    "veiculo": [r"\bve[ií]culos?\b", r"\bcarros?\b"],
}

# --- post keyword pre-filter ----------------------------------------------------------------
POST_KEYWORDS = (
    r"\b(roub|assalt|furt|levaram|arrast[aã]o|abord(a|aram|ou)|"
    r"perd[ie]u (a |o |meu |minha )?(celular|carteira|bolsa|mochila|carro|moto)|"
    r"poste apagado|sem ilumin|rua escura|terreno baldio|caland[ãa]o|"
    r"ponto cego|sem c[âa]mera|abandonad[ao])"
)
RELEVANT_CATEGORIES = ["roubo", "furto", "fator_urbano_relacionado"]

# --- street names ---------------------------------------------------------------------------
REPEATED_PREFIX = r"\b(avenida|rua|praca|praça|vila|travessa|alameda|estrada)\s+\1\b"
REPEATED_LEADING_PREFIX = r"^(praia|praca)\s+\1\s+"
STREET_ABBREVIATIONS = [
    (r"\bR\b\.?", "RUA"),
    (r"\bAV\b\.?", "AVENIDA"),
    (r"\bAVDA\b\.?", "AVENIDA"),
    (r"\bPCA\b\.?", "PRACA"),
    (r"\bPR\b\.?", "PRACA"),
    (r"\bTRV\b\.?", "TRAVESSA"),
    (r"\bEST\b\.?", "ESTRADA"),
    (r"\bALM\b\.?", "ALMIRANTE"),
    (r"\bGEN\b\.?", "GENERAL"),
    (r"\bPRES\b\.?", "PRESIDENTE"),
]

# --- agencies -------------------------------------------------------------------------------
AGENCY_NAMES = {
    "Rio Luz": "RioLuz",
    "RIOLUZ": "RioLuz",
    "RIOLUZ - Companhia Municipal de Energia e Iluminação": "RioLuz",
    "Ouvidoria RIOLUZ": "RioLuz",
    "COMLURB": "COMLURB",
    "COMLURB - Companhia Municipal de Limpeza Urbana": "COMLURB",
    "Ouvidoria COMLURB": "COMLURB",
    "SECONSERVA": "SECONSERVA",
    "CGC - Coordenadoria Geral de Conservação": "SECONSERVA",
    "Ouvidoria SECONSERVA": "SECONSERVA",
    "SEOP": "SEOP",
    "GM-Rio": "GM-Rio",
    "GM-RIO - Guarda Municipal do Rio de Janeiro": "GM-Rio",
    "Ouvidoria GM-RIO": "GM-Rio",
    "CET-Rio": "CET-Rio",
    "CET-RIO": "CET-Rio",
    "SMAS": "SMAS",
    "SMTR": "SMTR",
}
# tried in this order on the upper-case name when the exact name is unknown
AGENCY_WORDS = [
    ("RioLuz", ["RIOLUZ"]),
    ("COMLURB", ["COMLURB"]),
    ("GM-Rio", ["GM-RIO", "GUARDA"]),
    ("CET-Rio", ["CET"]),
    ("SMAS", ["SMAS", "CAS"]),
    ("SMTR", ["SMTR"]),
    ("SECONSERVA", ["01A", "02A", "03A", "04A", "05A", "21A", "CGC", "SECONSERVA"]),
    ("SEOP", ["SEOP"]),
]
AGENCY_PREFIX = ("SMTR", "TR/")

FACTOR_AGENCY = {
    "Vegetação encobrindo iluminação pública": "COMLURB",
    "Vegetação obstruindo a visibilidade do passeio": "COMLURB",
    "Lixo/entulho obstruindo a visibilidade": "COMLURB",
    "Lixo/entulho forçando pedestres à pista": "COMLURB",
    "Área mal iluminada com circulação de pedestres": "Rio Luz",
    "Área mal iluminada com parada de veículos": "Rio Luz",
    "Mobiliário urbano desviando pedestres para a pista": "SECONSERVA",
    "Calçada estreita forçando pedestres à pista": "SECONSERVA",
    "Mobiliário abandonado servindo de esconderijo": "SECONSERVA",
    "Tapumes servindo de esconderijo": "SECONSERVA",
    "Mobiliário/estrutura servindo de esconderijo": "SECONSERVA",
    "Vãos ou cavidades usados como esconderijo": "SECONSERVA",
    "Comércio irregular obstruindo a visibilidade do passeio": "SEOP",
    "Estacionamento irregular forçando pedestres à pista": "SEOP",
    "Veículos de grande porte obstruindo a visibilidade": "SEOP",
    "Ponto de retenção do tráfego": "CET-Rio",
    "Motocicletas trafegando no passeio": "GM-Rio",
    "Ponto de ônibus com histórico de vandalismo": "SMTR",
    "Pessoas em situação de rua": "SMAS",
    "Cena de uso de drogas": "SMAS",
    "Praças e Parques": "SECONSERVA",
}

CALL_TYPE_FACTOR = {
    "Iluminação Pública": "iluminacao_deficiente",
    "Manejo Arbóreo": "vegetacao_densa",
    "Remoção Gratuita": "lixo_entulho",
    "Limpeza de logradouros": "lixo_acumulado",
    "Pavimentação": "via_degradada",
    "Calçadas": "calcada_degradada",
    "Drenagem e Saneamento": "infraestrutura_precaria",
    "Comércio ambulante": "comercio_irregular",
    "Estacionamento irregular": "desordem_urbana",
    "Perturbação do sossego": "desordem_urbana",
    "Atendimento Social": "populacao_rua",
    "Semáforo": "sinalizacao_deficiente",
}

PROPERTY_TIP_TYPES = [
    "ROUBO/FURTO A TRANSEUNTES",
    "SUSPEITA DE ROUBO/FURTO",
    "ROUBO A MOTORISTAS",
    "ROUBO EM TRANSP COLETIVOS",
    "FURTO",
    "ROUBO",
]
PROPERTY_TIP_CLASSES = ["CRIMES CONTRA O PATRIMÔNIO"]

# --- street coincidence points (lower bounds of the levels, points of the levels) ----------
BINGO_CRIME_THRESHOLDS = [0, 1, 6, 16, 30]
BINGO_CRIME_SCORES = [0, 1, 2, 3, 4]
BINGO_FACTOR_THRESHOLDS = [0, 1, 3, 5]
BINGO_FACTOR_SCORES = [0, 1, 2, 3]
BINGO_TIP_THRESHOLDS = [0, 1, 4]
BINGO_TIP_SCORES = [0, 1, 2]
BINGO_BLIND_SPOT_CRIMES = 5
BINGO_PRIORITY = [(8, "CRITICA"), (6, "ALTA"), (3, "MEDIA"), (0, "BAIXA")]
BINGO_COMBOS = [
    ["Vegetação encobrindo iluminação pública", "Área mal iluminada com circulação de pedestres"],
    ["Mobiliário abandonado servindo de esconderijo", "Pessoas em situação de rua"],
    ["Comércio irregular obstruindo a visibilidade do passeio", "Ponto de retenção do tráfego"],
]

# --- area score -----------------------------------------------------------------------------
AREA_SCORE_PARTS = {"crime": 40.0, "peak": 15.0, "factors": 25.0, "tips": 15.0, "report": 5.0}
RISK_LEVELS = [(65, "critico"), (45, "alto"), (30, "medio"), (0, "baixo")]
RISK_COLOURS = [(60, "red"), (40, "accent"), (25, "amber"), (0, "muted")]

# --- event severity ---------------------------------------------------------------------------
CRIME_TYPE_WEIGHT = {
    "sequestro_relampago": 25.0,
    "roubo_residencia": 22.0,
    "roubo_carga": 20.0,
    "roubo_transporte_coletivo": 18.0,
    "roubo_veiculo": 16.0,
    "roubo_interior_veiculo": 14.0,
    "roubo_estabelecimento": 14.0,
    "roubo_transeunte": 12.0,
    "furto_veiculo": 10.0,
    "golpe_fraude": 8.0,
    "furto": 6.0,
    "outro": 5.0,
    "desconhecido": 4.0,
}
CRIME_TYPE_DEFAULT = 4.0
# (only shown, used)
WEAPON_WEIGHT = {
    "arma_fogo": (14.0, 20.0),
    "arma_branca": (8.0, 12.0),
    "objeto_contundente": (4.0, 8.0),
    "simulacro": (6.0, 6.0),
    "quimico": (5.0, 10.0),
    "forca_fisica": (0.0, 4.0),
    "outra": (3.0, 5.0),
    "nenhuma": (0.0, 0.0),
    "desconhecida": (0.0, 0.0),
}
WEAPON_CAP = 20.0
TACTIC_WEIGHT = {
    "disparo_arma_fogo": 15.0,
    "facada": 12.0,
    "coronhada": 8.0,
    "ferimento_grave": 12.0,
    "ferimento_leve": 5.0,
    "agressao_fisica": 6.0,
    "combate_fisico": 5.0,
    "arrastao": 5.0,
    "perseguicao": 3.0,
    "ameaca_arma_fogo": 4.0,
    "ameaca_arma_branca": 3.0,
    "ameaca_verbal": 2.0,
    "golpe_bancario": 4.0,
    "golpe_engenharia_social": 3.0,
    "furto_discreto": 1.0,
    "receptacao": 1.0,
    "outro": 1.0,
}
TACTIC_CAP = 15.0
VICTIM_AGE_WEIGHT = {"crianca": 5.0, "idoso": 5.0, "adolescente": 2.0}
VICTIM_VULNERABLE = ["idoso", "crianca"]
VICTIM_EXPOSED = 2.0
VICTIM_INJURED = 5.0
VICTIM_KILLED_FLOOR = 10.0
VICTIM_CAP = 10.0
OUTCOME_WEIGHT = {
    "consumado": 10.0,
    "tentativa_fracassada": 4.0,
    "interrompido_por_terceiros": 3.0,
    "agente_preso_em_flagrante": 0.0,
    "agente_neutralizado": 0.0,
    "desconhecido": 5.0,
}
OUTCOME_CAP = 10.0
MULTI_AGENT_WEIGHT = 4.0
ESCAPE_WEIGHT = {
    "veiculo_alta_velocidade": 3.0,
    "entrou_em_comunidade": 3.0,
    "pulou_muro": 2.0,
    "entrou_na_mata": 2.0,
    "transporte_coletivo": 1.0,
    "veiculo_discreto": 1.0,
}
APPROACH_WEIGHT = {"cerco": 3.0, "sequestro_relampago": 3.0, "arrastao": 2.0}
ORGANISATION_CAP = 10.0
ITEM_WEIGHT = {
    "conta_bancaria_acessada": 10.0,
    "celular_desbloqueado": 6.0,
    "carro": 5.0,
    "moto": 5.0,
    "mercadoria_comercial": 4.0,
    "notebook": 3.0,
    "documentos": 3.0,
    "relogio": 2.0,
    "cordao_joia": 2.0,
    "cartao_bancario": 2.0,
    "bolsa_mochila": 1.0,
    "celular": 1.0,
    "dinheiro_especie": 1.0,
    "outro": 1.0,
    "desconhecido": 0.0,
    "chaves": 0.0,
    "bicicleta": 1.0,
    "roupas_tenis": 1.0,
}
ITEM_CAP = 10.0
EVENT_FLOOR = 5.0
EVENT_CEIL = 100.0

# --- unit score -------------------------------------------------------------------------------
AGG_ALPHA = 3.5
AGG_BETA = 1.0
AGG_GAMMA = 10.0
AGG_CEIL = 100.0
ENV_COMBOS = [
    (["iluminacao_deficiente", "vegetacao_cobrindo_iluminacao"], 1.15),
    (["mobiliario_abandonado", "pessoas_em_situacao_rua"], 1.10),
    (["comercio_irregular", "ponto_retencao_trafego"], 1.10),
    (["tapume_vao_esconderijo", "calcada_estreita"], 1.08),
]
ENV_BLIND_MULT = 1.20
ENV_BLIND_MIN_SCORE = 30.0
ENV_PATROL_GAP_SHARE = 0.30
ENV_PATROL_GAP_MULT = 1.25
ENV_GOOD_COVER_MULT = 0.85
ENV_GOOD_LIGHT_SHARE = 0.5
ENV_FLOOR = 0.80
ENV_CEIL = 1.50
SOURCE_MULT = {1: 0.85, 2: 1.00, 3: 1.10, 4: 1.20, 5: 1.20}
SOURCE_MULT_MANY = 1.20
FEEDBACK_SUCCESS_DROP = 0.30
FEEDBACK_SUCCESS_DELTA = -15.0
FEEDBACK_INERT_DROP = 0.10
FEEDBACK_INERT_DELTA = 8.0
FEEDBACK_FLOOR = -20.0
FEEDBACK_CEIL = 10.0
PRIORITY_CUTS = [(80, "CRITICA"), (60, "ALTA"), (35, "MEDIA"), (0, "BAIXA")]
UNKNOWN_AREA = "DESCONHECIDA"
UNKNOWN_WORDS = ["desconhecido", "desconhecida"]

# --- fleet ------------------------------------------------------------------------------------
FLEET_SIZE = 600
FLEET_FLOOR = 25
FLEET_MAX_SHARE = 0.35
SHIFT_WEIGHTS = {
    "madrugada": 0.10,
    "amanhecer": 0.08,
    "manha": 0.18,
    "tarde": 0.22,
    "entardecer": 0.20,
    "noite": 0.22,
}
# reason code (or its beginning) -> suggested action
ACTION_TEXT = [
    ("combo.iluminacao_deficiente_vegetacao_cobrindo_iluminacao", True,
     "Solicitar Rio Luz (reparo de iluminação) + COMLURB (poda de vegetação)."),
    ("combo.mobiliario_abandonado_pessoas_em_situacao_rua", True,
     "SECONSERVA (remoção de mobiliário) + SMAS (abordagem social)."),
    ("combo.comercio_irregular", True, "SEOP — operação de remoção de comércio irregular."),
    ("env.camera_blind", False,
     "Avaliar instalação ou remanejamento de câmera CIVITAS no trecho."),
    ("env.patrol_gap", False,
     "Revisar a janela de troca de patrulha — agendar sobreposição."),
    ("agg.pattern", False,
     "Patrulhamento ostensivo concentrado no turno-pico identificado."),
    ("weapon.", True, "Reforço com viatura armada — perfil de eventos com arma de fogo."),
    ("victim.vulnerability", False,
     "Ação preventiva orientada (cartilha + abordagem) em pontos de vulnerabilidade."),
    ("agent.organization", False,
     "Mapear rotas de fuga com o RELINT — operação conjunta PMERJ se houver indício de ORCRIM."),
    ("fb.displacement_or_inert", False,
     "Investigar migração: monitorar logradouros vizinhos no próximo ciclo."),
]
ACTION_WEAPON_MIN_DELTA = 14.0

# --- roster -----------------------------------------------------------------------------------
ROSTER_AGENTS = 600
ROSTER_FLOOR = 12
ROSTER_SHIFTS = 4
ROSTER_WEIGHTS = {"mancha": 40.0, "pico": 15.0, "fatores": 25.0, "dinamica": 15.0}
BICYCLE_AREAS = ["jardim de alah", "botafogo", "rio sul", "copacabana"]
MODE_BASE = {"pe": 50, "moto": 25, "viatura": 15, "bicicleta": 10, "social": 0}
# mode -> (text when its measure is above the bound, bound, plain text); %s is the measure
MODE_RATIONALE = {
    "pe": ("%s% do modus operandi é a pé — presença densa nos trechos", 40, "Presença visível nas vias de maior movimento"),
    "moto": ("%s% dos crimes são noturnos — agilidade de resposta essencial", 65, "Cobertura dinâmica do eixo viário principal"),
    "viatura": ("%s% dos crimes registrados com arma de fogo", 15, "Base de apoio e resposta a ocorrências graves"),
    "bicicleta": ("", None, "Orla/parque — patrulha silenciosa com maior alcance"),
    "social": ("%s pessoas em situação de rua mapeadas", None, ""),
}
STREET_PEOPLE_POSITION = ("Pontos de concentração de PSR", "07h–11h e 18h–22h", "abordagem social — %s PSR mapeados")
STREET_PEOPLE_POSITION_MIN = 100

# --- displacement -----------------------------------------------------------------------------
YOY_DEAD_BAND = 10.0
DISTRICT_METRICS = [
    "hom_doloso", "letalidade_violenta", "total_roubos", "roubo_transeunte",
    "roubo_celular", "roubo_em_coletivo", "trafico_drogas", "total_furtos",
]

# --- intelligence reports: file-name code -> area -----------------------------------------------
REPORT_AREAS = {
    "RI_010": "Rodoviária - Terminal Gentileza - Estação Leopoldina",
    "RI_011": "Metrô Botafogo - Rua São Clemente - Rua Voluntários da Pátria",
    "RI_012": "Jardim de Alah",
    "RI_013": "Campo Grande: Estação de Trem - Calçadão",
    "RI_014": "Rio Sul",
    "RI_015": "Praia de Botafogo - Rua Marquês de Abrantes",
    "RI_016": "Estações São Francisco Xavier - Afonso Pena",
    "RI_017": "Presidente Vargas - Campo de Santana - Central do Brasil - Cinelândia",
}
COAST_BASE = ("Litorânea", ["Botafogo", "Copacabana"])
CENTRAL_BASE = "Central"

ARTICLE_DATE = r"(\d{2})/(\d{2})/(\d{4})\s+(\d{2})h(\d{2})"
ARTICLE_AUTHOR = r"Por\s+([^—\d]+?)(?:—|\d|$)"

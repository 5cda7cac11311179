"""Names, texts and tables that results must carry as they are."""

IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp")

DEFAULT_STORE = "Desconhecido"
DEFAULT_CATEGORY = "Outros"

STATUS_PENDING = "pendente"
STATUS_DONE = "processado"
STATUS_ERROR = "erro"

MSG_NO_JSON = "Nenhum JSON encontrado na resposta"
MSG_BAD_JSON = "JSON inválido"
MSG_NO_PRODUCTS_KEY = "Campo 'produtos' não encontrado"
MSG_PRODUCTS_NOT_LIST = "Campo 'produtos' deve ser uma lista"
MSG_NO_PRODUCTS = "Nenhum produto encontrado"

MAPPING_UNMAPPED = "Não Mapeada"
MAPPING_NO_SUGGESTION = "Sem Sugestão"
MAPPING_EXACT = "Exata"
MAPPING_MAPPED = "Mapeada"

METRIC_TOTAL = "Total de Produtos"
METRIC_NORMALIZED = "Produtos com Nome Normalizado"
METRIC_BARCODE = "Produtos com Código de Barras"
METRIC_DISTINCT = "Nomes Únicos (Normalizados)"

# Seed categories: (nome, descricao, icone), ids follow this order.
CATEGORIES = (
    ("Bebidas", "Bebidas em geral (refrigerantes, sucos, água, etc)", "🥤"),
    ("Bebidas Alcoólicas", "Cervejas, vinhos, destilados e bebidas alcoólicas", "🍺"),
    ("Carnes", "Carnes bovinas, suínas, aves e pescados", "🥩"),
    ("Frios e Laticínios", "Queijos, presunto, iogurtes, leite e derivados", "🧀"),
    ("Frutas", "Frutas frescas e in natura", "🍎"),
    ("Verduras e Legumes", "Hortaliças, verduras e legumes frescos", "🥬"),
    ("Mercearia", "Produtos secos (arroz, feijão, macarrão, óleos)", "🛒"),
    ("Panificação", "Pães, bolos e produtos de padaria", "🍞"),
    ("Doces e Sobremesas", "Chocolates, balas, bombons e sobremesas", "🍫"),
    ("Molhos e Temperos", "Molhos, condimentos e temperos", "🧂"),
    ("Higiene Pessoal", "Produtos de higiene e cuidados pessoais", "🧴"),
    ("Limpeza", "Produtos de limpeza e higiene doméstica", "🧹"),
    ("Utilidades", "Itens diversos e utilidades domésticas", "🔧"),
    ("Congelados", "Produtos congelados", "❄️"),
    ("Outros", "Produtos sem categoria específica", "📦"),
)

# Suggested category -> category, in matching order (the first match wins).
CATEGORY_MAP = (
    ("bebidas em pó", "Bebidas"),
    ("bebidas em po", "Bebidas"),
    ("refrigerantes", "Bebidas"),
    ("sucos", "Bebidas"),
    ("água", "Bebidas"),
    ("agua", "Bebidas"),
    ("bebidas alcoolicas", "Bebidas Alcoólicas"),
    ("bebidas alcoólicas", "Bebidas Alcoólicas"),
    ("cervejas", "Bebidas Alcoólicas"),
    ("vinhos", "Bebidas Alcoólicas"),
    ("destilados", "Bebidas Alcoólicas"),
    ("carne bovina", "Carnes"),
    ("carne suína", "Carnes"),
    ("carne suina", "Carnes"),
    ("aves", "Carnes"),
    ("frango", "Carnes"),
    ("peixes", "Carnes"),
    ("pescados", "Carnes"),
    ("açougue", "Carnes"),
    ("acougue", "Carnes"),
    ("laticinios", "Frios e Laticínios"),
    ("laticínios", "Frios e Laticínios"),
    ("queijos", "Frios e Laticínios"),
    ("frios", "Frios e Laticínios"),
    ("iogurtes", "Frios e Laticínios"),
    ("leite", "Frios e Laticínios"),
    ("frutas frescas", "Frutas"),
    ("hortifruti", "Frutas"),
    ("verduras", "Verduras e Legumes"),
    ("legumes", "Verduras e Legumes"),
    ("hortaliças", "Verduras e Legumes"),
    ("hortalicas", "Verduras e Legumes"),
    ("temperos frescos", "Verduras e Legumes"),
    ("mercearia seca", "Mercearia"),
    ("grãos", "Mercearia"),
    ("graos", "Mercearia"),
    ("arroz", "Mercearia"),
    ("feijão", "Mercearia"),
    ("feijao", "Mercearia"),
    ("macarrão", "Mercearia"),
    ("macarrao", "Mercearia"),
    ("massas", "Mercearia"),
    ("óleos", "Mercearia"),
    ("oleos", "Mercearia"),
    ("ingredientes", "Mercearia"),
    ("ingredientes para confeitaria", "Mercearia"),
    ("pães", "Panificação"),
    ("paes", "Panificação"),
    ("padaria", "Panificação"),
    ("bolos", "Panificação"),
    ("doces", "Doces e Sobremesas"),
    ("chocolates", "Doces e Sobremesas"),
    ("balas", "Doces e Sobremesas"),
    ("sobremesas", "Doces e Sobremesas"),
    ("guloseimas", "Doces e Sobremesas"),
    ("molhos", "Molhos e Temperos"),
    ("condimentos", "Molhos e Temperos"),
    ("temperos", "Molhos e Temperos"),
    ("temperos secos", "Molhos e Temperos"),
    ("higiene", "Higiene Pessoal"),
    ("higiene pessoal", "Higiene Pessoal"),
    ("cosméticos", "Higiene Pessoal"),
    ("cosmeticos", "Higiene Pessoal"),
    ("perfumaria", "Higiene Pessoal"),
    ("produtos de limpeza", "Limpeza"),
    ("limpeza doméstica", "Limpeza"),
    ("limpeza domestica", "Limpeza"),
    ("produtos congelados", "Congelados"),
    ("alimentos congelados", "Congelados"),
    ("frozen", "Congelados"),
)

# Legacy category text -> category, used once to back-fill ids.
LEGACY_CATEGORY_MAP = (
    ("Bebidas", "Bebidas"),
    ("Bebidas Alcoólicas", "Bebidas Alcoólicas"),
    ("Carnes", "Carnes"),
    ("Frios", "Frios e Laticínios"),
    ("Laticínios", "Frios e Laticínios"),
    ("Frutas", "Frutas"),
    ("Verduras", "Verduras e Legumes"),
    ("Temperos", "Verduras e Legumes"),
    ("Mercearia", "Mercearia"),
    ("Panificação", "Panificação"),
    ("Doces", "Doces e Sobremesas"),
    ("Molhos", "Molhos e Temperos"),
    ("Higiene Pessoal", "Higiene Pessoal"),
    ("Limpeza", "Limpeza"),
    ("", "Outros"),
)

# Column limits of the stored tables.
MAX_PRODUCT_NAME = 255
MAX_BRAND = 100
MAX_CATEGORY = 100
MAX_UNIT = 50
MAX_STORE_NAME = 255
MAX_BARCODE = 13
PRICE_LIMIT = 100_000_000  # DECIMAL(10,2)
CONFIDENCE_LIMIT = 10  # DECIMAL(3,2)

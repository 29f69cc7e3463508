"""Secret scanning with a random forest that removes false positives; DataFrame and SQL functions only.

Candidates are runs of at least 12 key characters that hold a digit. "=" ends a name, so the value after it is a
candidate of its own, of 6 characters at least; only as padding at the end of a value is it part of one. Right behind a
name of a secret and an assignment, any value of 8 characters is a candidate, without a digit too, and with the
marks that passwords have: what stays is the forest's to say. Each is described by its length, its
character transitions, how much of it dictionary words cover, whether it or its surroundings look like a path,
and the words beside it; a random forest trained on labelled findings gives the chance that it is a secret.

labelled_findings() makes FINDINGS labelled findings (a documented bound) by hashing row numbers: keys of common
kinds and random tokens in the contexts where they leak, against what scanners usually mistake for them:
payment and phone numbers, host names, paths, versions, commit and checksum digests, UUIDs, placeholders and
identifiers. They are rendered as texts and cut out by candidates(), so that training and scan see the same contexts;
names that become candidates beside them are labelled 0. train() takes any other table of (candidate, before, after, label) instead.

Offsets are code points, end exclusive. Defined results: null or empty text has no candidates and gives no
rows; a repeated document row gives its candidates again; a null doc_id is kept; an empty table gives an empty
table; other columns are ignored. Whole texts are scanned, and a run of any length is one candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINDINGS, TREES, DEPTH = 6000, 24, 6
CONTEXT = 48
SHORTEST, SHORTEST_VALUE = 12, 6
_CHARS = r"A-Za-z0-9+/_.\-"
#: Padding is at most two "=" that neither a value nor an opening quote follows.
_PADDING = rf"(?:={{1,2}}(?![{_CHARS}=]|[\"'`][^\s,;:.)\]}}>]))?"
#: The left side of a value that a name of a secret is given; its last characters are looked at first, for that is cheap.
_NAMED = r"(?<=[=:][ ]?[\"'`]?)(?<=(?i:passw(?:or)?d|passwort|passphrase|pwd|secret|token|api[_-]?key|contrasena|clave|motdepasse)[\"']?[ ]?[=:][ ]?[\"'`]?)"
_GENERAL = rf"(?=[A-Za-z+/_.\-]*[0-9])(?:[{_CHARS}]{{{SHORTEST - 1},}}|(?<==)[{_CHARS}]{{{SHORTEST_VALUE - 1},}})[A-Za-z0-9+/_\-]"
_PASSWORD = rf"{_NAMED}[{_CHARS}!@#$%^*]{{7,}}[A-Za-z0-9+/_\-!@#$%^*]"
CANDIDATE = rf"(?<![{_CHARS}])(?:{_PASSWORD}|{_GENERAL}){_PADDING}"

#: Kinds by shape, first match wins.
KINDS = (
    ("aws_key", "^(AKIA|ASIA)[0-9A-Z]{16}$"), ("github_token", "^gh[pousr]_[A-Za-z0-9]{36,}$"), ("slack_token", "^xox[abprs]-[0-9A-Za-z-]{10,}$"), ("google_key", "^AIza[0-9A-Za-z_-]{35}$"),
    ("stripe_key", "^[rs]k_(live|test)_[0-9a-zA-Z]{16,}$"), ("jwt", "^eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+$"), ("uuid", "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"),
    ("number", "^[0-9.+-]+$"), ("hex", "^[0-9a-fA-F]{24,}$"), ("host", "^[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)*\\.[a-z]{2,}$"), ("path", "^[A-Za-z0-9._=-]*(/[A-Za-z0-9._=-]+)+/?$"),
)
_WORDS = (
    "about access account action address admin after agent alpha android apache app application archive array article asset async author auto back base "
    "before beta bin block body book boot branch browser bucket build bundle button cache call card category change channel chapter check class client "
    "cloud code collection color column com comment common component config connect console content context control core count create current custom data "
    "database date debug default delete demo deploy detail device digest dir direct dist doc document domain down draft edit email enable end engine entry "
    "error event example export face factory feature field file filter final find first folder font form format frame free from function game gateway "
    "general get global graph group handler hash head header help home host html icon image img import index info input install instance internal item java "
    "job json kernel key label language last latest layer layout legacy level lib library license line link linux list load local lock log login mail main "
    "manager map master media menu message meta method mobile mode model module monitor name net network new news next node note number object office "
    "offset online open option order org origin out output package page panel param parent part patch path pattern photo php plan platform player plugin "
    "point policy port post print private process product profile project property provider proxy public query queue random read record ref region registry "
    "release remote repo report request reset resource response rest result return role root route row rule run sample schema scope script search section "
    "secure select send server service session set setting shop show sign simple site size sort source space spec sql stack start state static status step "
    "storage store stream string style sub submit summary support sync system tab table tag target task team template term test text theme thread time "
    "title token tool top total track train tree trigger type unit update upload url user util value version video view web widget window word work world "
    "www year zone "
    # German, French and Spanish, without accents as in identifiers
    "abfrage abschnitt aktion aktuell anfrage anmeldung antwort anwendung anzahl anzeige artikel auftrag ausgabe auswahl autor beispiel benutzer bereich "
    "bericht bestellung bild datei daten datum dienst druck eingabe eintrag ende ergebnis fehler feld fenster firma funktion gruppe haupt hilfe inhalt jahr "
    "karte kategorie klasse konto kunde laden liste meldung menge nachricht name netz nummer objekt ordner passwort preis produkt projekt quelle rechnung "
    "schluessel seite server sprache stadt start status strasse suche tabelle teil text titel uebersicht verwaltung vorlage welt wert zahl zeile zeit ziel "
    "zugriff "
    "acces accueil adresse affichage ajout annee appel article auteur bouton cadre carte categorie champ chemin classe clef client colonne commande compte "
    "connexion contenu date demande dernier donnee dossier element entree envoi erreur etat exemple fichier fonction forme groupe heure image jour langue "
    "lecture ligne liste livre message modele monde niveau nombre nouveau numero objet outil page paiement panier partie poste premier prix produit projet "
    "recherche region reponse requete reseau resultat retour service site source sujet table temps texte titre type utilisateur valeur vente ville "
    "acceso actual ajuste archivo articulo autor ayuda boton busqueda cabecera cadena campo cantidad carpeta categoria ciudad clase clave cliente codigo "
    "columna compra consulta contenido contrasena correo cuenta dato descarga destino direccion documento ejemplo elemento enlace entrada envio estado "
    "etiqueta factura fecha fila formulario fuente grupo historia hora idioma imagen informe inicio lista llave lugar mensaje mundo nivel nombre nuevo "
    "numero objeto orden pagina pais palabra pedido perfil precio primero producto proyecto prueba registro respuesta resultado salida servicio sitio tabla "
    "tiempo tienda tipo titulo usuario valor venta version vista "
)
_DICTIONARY = "(" + "|".join(sorted({w for w in _WORDS.split() if len(w) > 2}, key=lambda w: (-len(w), w))) + ")"
_GOOD = "(token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|signature)"
_BAD = "(example|sample|placeholder|dummy|fake|sha1|sha256|md5|commit|checksum|digest|etag|revision|version|uuid|guid|order|invoice|card|phone|tel|iban|isbn|href|src|url|http|mailto|id)"

FEATURES = ("length", "long_runs", "switches", "hex_switches", "digits", "uppers", "lowers", "marks", "variety", "vowels", "dictionary", "slashes", "dots", "path_near", "good_near", "bad_near", "assigned", "quoted", "shaped")


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """Features of a candidate and the text on both sides."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    near, tail = F.lower(before), F.lower(F.right(before, F.lit(24)))
    flag = lambda x: x.cast("double")
    return {
        "length": F.least(n, F.lit(200.0)),
        "long_runs": F.regexp_count(c, F.lit("[a-z]{5,}|[A-Z]{5,}|[0-9]{7,}")) / n,
        "switches": (F.regexp_count(c, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")) - 1) / n,
        "hex_switches": F.regexp_count(c, F.lit("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]")) / n,
        "digits": share("[0-9]"), "uppers": share("[A-Z]"), "lowers": share("[a-z]"), "marks": share("[^A-Za-z0-9]"),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        "vowels": share("[aeiouAEIOU]"),
        "dictionary": 1 - F.length(F.regexp_replace(F.lower(c), _DICTIONARY, "")) / n,
        "slashes": share("/"), "dots": share("[.]"),
        "path_near": flag(tail.rlike("(https?:|href|src|www|/|@|\\\\)[\"'=: ]{0,3}$") | F.lower(c).rlike("[.](html?|php|js|css|png|jpe?g|gif|svg|pdf|json|xml|txt|com|org|net|io)$")),
        "good_near": flag(tail.rlike(_GOOD)),
        "bad_near": flag(near.rlike(_BAD + "[^a-z]*$")),
        "assigned": flag(tail.rlike("[=:][ ]?[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "shaped": flag(c.rlike("|".join(p for k, p in KINDS if k.endswith(("_key", "_token")) or k == "jwt"))),
    }


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """candidate, before, after, label: made from hashes of row numbers, the same each time."""
    hashed = "sha2(concat('{0}', id), 512)"
    b64 = "translate(base64(unhex(sha2(concat('{0}', id), 512))), '\\n', '')"
    pick = lambda salt, *xs: f"element_at(array({', '.join(repr(x) for x in xs)}), cast(pmod(xxhash64(id, {salt}), {len(xs)}) as int) + 1)"
    digits = "translate(substr(" + hashed + ", 1, 40), 'abcdef', '123456')"
    leak = pick(1, 'token = "', "secret: ", "API_KEY=", 'password = "', "Authorization: Bearer ", "auth_token='", "access_key: ", 'client_secret="', "the token is ", "private_key = ", "credentials: ", "AWS_SECRET_ACCESS_KEY=", 'my_api_token_v2 = "', "DB_PASSWORD_PROD_1=", "/login?api_key=", "&token=")
    bare = pick(2, "", " ", "see ", '= "', "value: ", "x = ", "set ", "- ")
    plain = pick(3, "the ", "of ", "and ", "le ", "der ", "", "with ", "number ", "que ", "in ")
    word = pick(4, "report", "index", "main", "user", "config", "article", "image", "template", "server", "data")
    word2 = pick(5, "page", "view", "list", "model", "service", "table", "summary", "file", "archive", "client")
    word3 = pick(32, "horse", "battery", "correct", "window", "garden", "silver", "orange", "winter")
    named = pick(33, 'password = "', "secret: ", "token=", "passwd: '", 'api_key: "', "pwd=", "passphrase: ")
    length = "cast(20 + pmod(xxhash64(id, 6), 24) as int)"
    quote = f"case when right(before, 1) in ('\"', \"'\") then right(before, 1) else {pick(7, ' ', '', '.', ' and', chr(10))} end"
    part = pick(25, "", "", "img", "v", "p-", "item_")
    # kind -> (label, candidate, before)
    made = [
        (1, f"substr({hashed.format('a')}, 1, 40)", leak),
        (1, f"substr({hashed.format('b')}, 1, {length})", leak),
        (1, f"regexp_replace(substr({b64.format('c')}, 1, {length}), '[^A-Za-z0-9]', 'x7')", leak),
        (1, f"substr({b64.format('d')}, 1, {length})", leak),
        (1, f"concat('AKIA', upper(translate(substr({hashed.format('e')}, 1, 16), '01', 'QZ')))", pick(8, "", "aws_access_key_id = ", "AWS_ACCESS_KEY_ID=", '"', "key ", " ")),
        (1, f"concat('ghp_', regexp_replace(substr({b64.format('f')}, 1, 36), '[^A-Za-z0-9]', 'k'))", pick(9, "", "token ", "https://", '"', " ")),
        (1, f"concat({pick(10, 'sk_live_', 'rk_live_', 'xoxb-', 'AIzaSy')}, regexp_replace(substr({b64.format('g')}, 1, 33), '[^A-Za-z0-9]', '4'))", bare),
        (1, f"regexp_replace(substr({b64.format('h')}, 1, {length}), '[^A-Za-z0-9]', 'Q3')", bare),
        (1, f"substr(translate({b64.format('w')}, '+/', 'k4'), 1, cast(6 + pmod(xxhash64(id, 23), 9) as int))", pick(24, "password=", "DB_PASSWORD=", "secret=", "&token=", "passwd=", "API_KEY=", "auth=")),
        (1, f"substr(regexp_replace({b64.format('y')}, '[^A-Za-z]', ''), 1, cast(8 + pmod(xxhash64(id, 28), 16) as int))", named),
        (1, f"concat(initcap({word}), initcap({word2}), initcap({word3}), {pick(29, '!', '', '#', '$1', '')})", named),
        (0, f"{pick(30, 'required', 'something', 'optional', 'disabled', 'undefined', 'password', 'ingredients', 'management', 'authentication', 'unchanged')}", named),
        (0, f"concat({word2}, {pick(31, '-', '_', '.', '/')}, {word3}, {word})", named),
        (0, f"substr(concat({part}, {digits.format('x')}), 1, cast(6 + pmod(xxhash64(id, 26), 5) as int))", pick(27, "page=", "width=", "&id=", "utm_source=", "?v=", "lang=", "date=", "color=", "ref=")),
        (0, f"substr({digits.format('i')}, 1, 16)", plain),
        (0, f"substr({digits.format('j')}, 1, cast(12 + pmod(xxhash64(id, 11), 8) as int))", pick(12, "card ", "phone: ", "order ", "", "invoice = ", "tel: +", "?id=", "&ref=")),
        (0, f"concat({word}, substr({digits.format('k')}, 1, 1), '.', {word2}, '.com')", pick(13, "http://", "@", "www.", "", "host ", "see ")),
        (0, f"concat('/', {word}, '/', {word2}, '/', substr({digits.format('l')}, 1, 4), '/index.html')", pick(14, 'href="', "https://example.com", "src=", "path ", "")),
        (0, f"concat({word}, '_', {word2}, '_', substr({digits.format('m')}, 1, 3))", pick(15, "", "import ", "call ", 'id="', "the ")),
        (0, f"concat({word}, initcap({word2}), 'Handler', substr({digits.format('n')}, 1, 2))", pick(16, "", "class ", "new ", "= ", "token = ")),
        (0, f"substr({hashed.format('o')}, 1, 40)", pick(17, "commit ", "sha1: ", "sha1=", "revision ", "checksum: ", "etag ")),
        (0, f"substr({hashed.format('p')}, 1, 64)", pick(18, "sha256:", "digest ", "checksum = ", "sha256 ")),
        (0, f"concat_ws('-', substr({hashed.format('q')}, 1, 8), substr({hashed.format('q')}, 9, 4), substr({hashed.format('q')}, 13, 4), substr({hashed.format('q')}, 17, 4), substr({hashed.format('q')}, 21, 12))", pick(19, "uuid: ", "id=", "guid ", "", "record ")),
        (0, pick(20, "xxxxxxxxxxxx1234", "1234567890abcdef", "your_api_key_here_1", "changeme12345678", "0000000000000000", "example-token-123", "abcdefghij123456"), leak),
        (0, f"concat('v', substr({digits.format('r')}, 1, 1), '.', substr({digits.format('s')}, 1, 2), '.', substr({digits.format('t')}, 1, 3), '-release')", pick(21, "version ", "tag ", "", "at ")),
        (0, f"concat('2020-0', substr({digits.format('u')}, 1, 1), '-11T0', substr({digits.format('v')}, 1, 1), '.00.00')", plain),
    ]
    base = spark.range(rows, numPartitions=2).withColumn("kind", F.pmod("id", F.lit(len(made))))
    case = lambda i: "case kind " + " ".join(f"when {k} then {m[i]}" for k, m in enumerate(made)) + " end"
    made_of = base.select("id", F.expr(case(1)).alias("planted"), F.expr(f"concat({pick(22, '', 'and the ', 'note: ', 'x;')}, {case(2)})").alias("before"), F.expr(case(0)).cast("double").alias("label"))
    first, size = F.length("before"), F.length("planted")
    texts = made_of.select(F.struct("id", "label", first.alias("from"), (first + size).alias("to")).alias("doc_id"), F.concat("before", "planted", F.expr(quote)).alias("text"))
    met = (F.col("start") < F.col("doc_id.to")) & (F.col("end") > F.col("doc_id.from"))
    rows_of = candidates(texts).withColumns({"id": F.col("doc_id.id"), "label": F.when(met, F.col("doc_id.label")).otherwise(0.0)})
    # in one order, whatever the session's shuffle: the forest draws rows by position
    return rows_of.coalesce(1).sortWithinPartitions("id", "start").select("candidate", F.col("left").alias("before"), "after", "label")


def _assembled(df: DataFrame, c: Column, before: Column, after: Column) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    made = features(c, before, after)
    return VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="f_vector", handleInvalid="keep").transform(df.withColumns({f"f_{k}": made[k] for k in FEATURES}))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """A random forest on labelled findings (candidate, before, after, label 0/1)."""
    from pyspark.ml.classification import RandomForestClassifier

    rows = _assembled(findings.filter("candidate is not null and candidate <> '' and label is not null").fillna("", ["before", "after"]), F.col("candidate"), F.col("before"), F.col("after"))
    rows = rows.select("f_vector", F.col("label").cast("double").alias("label")).cache()
    try:
        return RandomForestClassifier(featuresCol="f_vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(rows)
    finally:
        rows.unpersist()


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, candidate, before, after, left: every candidate of whole texts, no Python involved.

    before and after reach to the neighbouring candidates at most; left is the CONTEXT characters of the text before
    the candidate, whatever they are. Text is cut at its candidates once; only the candidates and CONTEXT characters
    beside them are shuffled, to add up offsets and left sides along each row."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    text = F.col("text")
    pieces = F.transform(F.split(text, CANDIDATE, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(CONTEXT)).alias("tail"), F.left(p, F.lit(CONTEXT)).alias("head")))
    found = slim.select("row", "doc_id", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), pieces.alias("p"))).alias("pos", "z"))
    flat = found.select("row", "doc_id", "pos", F.col("z.c").alias("candidate"), "z.p.*").filter("not (pos = 0 and candidate is null)")
    along = Window.partitionBy("row").orderBy("pos")
    size = F.coalesce(F.length("candidate"), F.lit(0)).cast("bigint")
    # so many candidates of the shortest length fill CONTEXT; where a tail was cut, it fills CONTEXT alone
    unit = F.concat("tail", F.right(F.coalesce("candidate", F.lit("")), F.lit(CONTEXT)))
    passed = [F.coalesce(F.lag(unit, k).over(along), F.lit("")) for k in range(-(-CONTEXT // SHORTEST_VALUE), 0, -1)]
    placed = flat.withColumns({"left": F.right(F.concat(*passed, "tail"), F.lit(CONTEXT)), "end": F.sum(F.col("n") + size).over(along.rowsBetween(Window.unboundedPreceding, 0)), "after": F.lead("head").over(along)})
    return placed.filter("candidate is not null").select("doc_id", (F.col("end") - size).alias("start"), "end", "candidate", F.col("tail").alias("before"), F.coalesce("after", F.lit("")).alias("after"), "left")


def scan(docs: DataFrame, model=None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every candidate with kind, score (chance of being a secret) and is_secret."""
    from pyspark.ml.functions import vector_to_array

    model = model or train(labelled_findings(docs.sparkSession))
    kind = F.lit("generic")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.col("candidate").rlike(pattern), F.lit(name)).otherwise(kind)
    rows = _assembled(candidates(docs, id_col, text_col), F.col("candidate"), F.col("left"), F.col("after"))
    scored = model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("f_chance").transform(rows)
    score = vector_to_array("f_chance")[1]
    out = scored.select(F.col("doc_id").alias(id_col), "start", "end", "candidate", kind.alias("kind"), F.round(score, 9).alias("score"))
    return out.withColumn("is_secret", F.col("score") >= threshold)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings with the secret itself replaced by its SHA-256."""
    found = scan(docs, id_col=id_col, text_col=text_col)
    return found.select(id_col, "start", "end", "kind", F.sha2("candidate", 256).alias("secret_sha256"), "score", "is_secret")

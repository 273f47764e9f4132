"""Word lists and patterns. Everything in this file is a fixed value: results depend on the exact words."""

# --- Fixed values: reading titles and texts ---------------------------------------------------------

ROMAN_NUMERALS = {
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10",
    "xi": "11", "xii": "12", "xiii": "13", "xiv": "14", "xv": "15", "xvi": "16", "xvii": "17", "xviii": "18",
    "xix": "19", "xx": "20",
}
# In listing names a lone i, v or x is a letter, not a number.
LISTING_NUMERALS = {
    "ii": "2", "iii": "3", "iv": "4", "vi": "6", "vii": "7", "viii": "8", "ix": "9", "xi": "11", "xii": "12",
    "xiii": "13",
}
STOPWORDS = (
    "the", "a", "an", "of", "and", "or", "in", "on", "at", "to", "for", "with", "is", "it", "its", "this", "that",
    "from", "by", "as", "be", "was", "are", "game", "games", "ps2", "playstation", "new", "now", "my", "i", "you",
)
DISTINCTIVE_SHORT = ("ico", "okami", "vexx", "genji", "kessen")
NOT_TITLES = ("the cabal", "retro")
ORDINARY_TITLES = ("black", "gift", "gun", "scaler", "road trip", "world fighting", "bully")
CAPITALISED_TITLES = ("bully",)
GENERIC_HALVES = ("hardware", "anniversary")
LOOKALIKES = {
    "dragon rage": ("dragon age",),
    "astro boy": ("astro bot",),
    "crash tag team racing": ("crash team racing",),
    "legend of herkules": ("legend of heroes",),
    "nba street": ("street fighter",),
    "gran turismo 4": ("gran turismo 5", "gran turismo 6", "gran turismo 7", "gran turismo sport"),
}
FOLLOWERS = {
    "god of war": ("ragnarok", "ragnarök", "2018", "laufey"),
    "half life": ("2", "3", "alyx", "blue shift", "opposing force"),
    "monster hunter": ("wilds", "world", "rise", "stories", "outlanders", "now", "sunbreak", "iceborne", "puzzles"),
    "max payne": ("3", "remake", "1 2", "1 and 2"),
    "spider man": ("miles", "morales", "remastered", "remake", "4"),
    "miami vice": ("reboot", "ps5", "movie", "film"),
}
TITLE_ALIASES = {
    "gta 3": "Grand Theft Auto III",
    "gta vice city": "Grand Theft Auto: Vice City",
    "gta vc": "Grand Theft Auto: Vice City",
    "gta san andreas": "Grand Theft Auto: San Andreas",
    "gta sa": "Grand Theft Auto: San Andreas",
    "gta lcs": "Grand Theft Auto: Liberty City Stories",
    "gta vcs": "Grand Theft Auto: Vice City Stories",
    "re4": "Resident Evil 4",
    "code veronica": "Resident Evil Code: Veronica X",
    "mgs2": "Metal Gear Solid 2: Sons of Liberty",
    "mgs3": "Metal Gear Solid 3: Snake Eater",
    "ffx": "Final Fantasy X",
    "ff10": "Final Fantasy X",
    "ffx 2": "Final Fantasy X-2",
    "ff12": "Final Fantasy XII",
    "ffxii": "Final Fantasy XII",
    "kh2": "Kingdom Hearts II",
    "dmc3": "Devil May Cry 3: Dante's Awakening",
    "sh2": "Silent Hill 2",
    "sh3": "Silent Hill 3",
    "sh4": "Silent Hill 4: The Room",
    "sotc": "Shadow of the Colossus",
    "p3fes": "Persona 3 FES",
    "smt nocturne": "Shin Megami Tensei: Nocturne",
    "dq8": "Dragon Quest VIII: Journey of the Cursed King",
    "gow2": "God of War II",
    "jak and daxter": "Jak and Daxter: The Precursor Legacy",
    "rockstar bully": "Bully",
    "canis canem edit": "Bully",
}
JUNK_TITLE = (r"(?i)zzz_|demo disc|magazine demo|hits demo|network access disc|swap magic|action replay"
              r"|greatest hits vol|\bsampler\b")
CONTEXT = r"\b(?:ps2|ps 2|playstation ?2|pcsx2)\b"
TIME_UNITS = (
    "second", "seconds", "sec", "secs", "minute", "minutes", "min", "mins", "hour", "hours", "hr", "hrs", "day",
    "days", "week", "weeks", "month", "months", "year", "years", "yr", "yrs", "time", "times",
)

# --- Fixed values: flags and tone -------------------------------------------------------------------

REMASTER_STRONG = r"\b(?:remaster|remake|reboot|reviv|hd version|director['’]s cut|re-?release)"
REMASTER_WEAK = r"\b(?:collections?\b|ports?\b|ported\b|returns?\b|enhanced)"

_PLATFORM = (r"(?:(?:ps[45]|playstation\s*[45]|xbox(?:\s+series\s+[xs])?|switch\s*2?|nintendo\s+switch\s*2?|pc"
             r"|console)\s+)?")
_PHYSICAL = (r"(?:physical(?:\s+(?:media|games?|copies|copy|editions?|releases?|versions?|discs?))?"
             r"|discs?(?:\s+(?:drives?|versions?|releases?|editions?|copies|copy))?|cartridges?"
             r"|retail\s+(?:copies|copy|release|version))\b"
             r"(?!\s+(?:required|needed|swap\w*|left|remaining)\b)")
DIGITAL_WORDING = (r"\bdigital[\s-]*only\b"
                   r"|\b(?:all|fully|entirely|purely|exclusively|full|100%)[\s-]+digital\b"
                   r"|\bgo(?:es|ing|ne)?\s+(?:all[\s-]+)?digital\b")
DIGITAL_EVENT = (r"\b(?:showcase|presentation|event|direct|broadcast|livestream|stream|conference|ceremony|sale|bonus"
                 r"|deluxe|edition|foundry|bundle|comics?|e3|gamescom|state\s+of\s+play|game\s+awards"
                 r"|summer\s+game\s+fest|tokyo\s+game\s+show)\b")
DIGITAL_HOWTO = r"\b(?:opl|hdd|install(?:ing)?|emulat\w*|iso|usb|how\s+to|tutorial)\b"
PHYSICAL_GOING = (
    r"\bdisc[\s-]?less\b"
    r"|\bno\s+(?!(?:\w+\s+){0,3}(?:required|needed|swap\w*|left|remaining)\b)" + _PLATFORM + _PHYSICAL +
    r"|\b(?:won'?t|will\s+not|not|never|no\s+longer)\s+(?:be\s+)?(?:get(?:s|ting)?|have|having|receiv\w*|see\w*"
    r"|launch\w*\s+with|com\w*\s+with)\s+(?:an?\s+|any\s+)?" + _PLATFORM + _PHYSICAL +
    r"|\b" + _PHYSICAL + r".{0,40}?\bno\s+longer\b"
    r"|\bwithout\s+(?:an?\s+)?" + _PHYSICAL +
    r"|\b(?:skip|skips|skipping|skipped|lack|lacks|lacking|ditch|ditches|ditching|ditched|kill|kills|killing|killed"
    r"|end|ends|ending|ended|drop|drops|dropping|dropped|scrap|scraps|scrapping|scrapped|abandon\w*"
    r"|phas(?:e|es|ed|ing)\s+out|discontinu\w*|cancel\w*|pull\w*"
    r"|(?:stop\w*|no\s+longer)\s+(?:making|producing|releasing|selling|printing|manufacturing))\s+(?:off\s+)?"
    r"(?:(?:its|the|a|all|their|any)\s+)*(?:(?:(?:release|production)\s+)?of\s+)?(?:games?\s+on\s+)?"
    + _PLATFORM + _PHYSICAL +
    r"|\bend\s+of\s+(?:the\s+)?" + _PHYSICAL +
    r"|\b" + _PHYSICAL + r".{0,40}?\b(?:cancel\w*|scrapped|pulled|dropped|axed|dead|dying|discontinued"
    r"|phased\s+out|going\s+away)"
    r"|\bgame[\s-]?key\s+cards?\b"
    r"|\bphysical\s+media\b"
    r"|\bphysical\s+(?:vs\.?|versus|or)\s+digital\b|\bdigital\s+(?:vs\.?|versus|or)\s+physical\b"
    r"|\bcode[\s-]+in[\s-]+(?:a[\s-]+)?box\b"
    r"|\b(?:s[oó]lo|solamente|apenas|exclusivamente|somente)\s+(?:em\s+|en\s+)?digital\b"
    r"|\bsem\s+vers[aã]o\s+(?:em\s+)?(?:disco|f[ií]sica)\b|\bsin\s+(?:versi[oó]n\s+)?(?:f[ií]sica|disco)\b"
    r"|\bfim\s+dos\s+discos\b|\bfin\s+de\s+los\s+discos\b")

POSITIVE_STEMS = ("masterpiece", "amazing", "love", "best", "classic", "brilliant", "great", "favourite", "favorite",
                  "underrated", "gorgeous", "perfect")
NEGATIVE_STEMS = ("bug", "worst", "broken", "terrible", "flop", "disaster", "disappoint", "overrated", "awful",
                  "unplayable", "janky")
HYPE_STEMS = ("hype", "announce", "revival", "remaster", "remake", "confirmed", "leak")
NEGATORS = ("not", "no", "never", "isn", "aren", "wasn", "doesn", "didn", "won", "hardly", "barely")
NEGATION_WINDOW = 3

# --- Fixed values: collectible evidence in articles -------------------------------------------------

IN_WORLD_WORDS = (r"\b(?:in-game|player|players|character|characters|weapon|weapons|enemy|enemies|boss|loot"
                  r"|quest)\b")
_RARITY = r"(?:rare|rarer|scarce|sought[- ]after|out of print|highly valued)"
_COPY = r"(?:copies|copy|versions?|releases?|editions?|pressings?|print(?:ing)?s?|discs?)"
COLLECTIBLE = (
    ("rare", r"\b(?:become|became|becoming|becomes)\s+(?:an?\s+)?(?:somewhat\s+|very\s+|extremely\s+|highly\s+"
             r"|quite\s+)?" + _RARITY + r"\b"),
    ("rare", r"\b" + _RARITY + r"\s+(?:collect[ai]ble|collector'?s?\s+items?|" + _COPY + r")\b"),
    ("rare", r"\b" + _COPY + r"\b[^.;]{0,40}\b(?:are|is|have become|has become|became)\s+(?:now\s+)?(?:very\s+"
             r"|extremely\s+|highly\s+)?" + _RARITY + r"\b"),
    ("out of print", r"\bout of print\b"),
    ("low quantities", r"\b(?:low quantities|limited number of copies|limited print run|small print run)\b"),
    ("second-hand price", r"\b(?:pre-owned|second-?hand|used|resale|loose|complete)\s+(?:copies|market|prices?)"
                          r"[^.;]{0,60}[$£€]\s?\d"),
    ("expensive second-hand", r"\bexpensive\b[^.;]{0,40}\b(?:second-?hand|to buy|to collect"
                              r"|on the (?:resale|used) market)\b"),
)
BAD_ARTICLE_HINTS = ("disambiguation", "list of", "(franchise)", "(series)", "(company)")
ARTICLE_PLATFORM = r"PlayStation 2|\bPS2\b"

# --- Fixed values: marketplace listings -------------------------------------------------------------

PLATFORM_WORDS = r"\b(?:sony )?(?:playstation ?2|play station 2|ps ?2)\b"
DISC_WORDS = ("disc", "discs", "disk", "disks", "dvd", "cd", "player", "players")
JUNK_PHRASES = (
    "case only", "box only", "manual only", "cover only", "inlay only", "artwork only", "sleeve only", "booklet only",
    "no game", "no disc", "no disk", "empty case", "empty box", "replacement case", "replacement cover", "art only",
    "case inlay", "manual booklet", "reproduction", "repro", "bundle", "lot", "joblot", "strategy guide",
    "official guide", "guide book", "guidebook", "demo disc", "demo", "jampack", "jam pack", "press kit", "promo dvd",
    "famitsu", "magazine", "action replay", "gameshark", "game shark", "codebreaker", "code breaker", "cheats",
    "cheat disc", "hat", "shirt", "figure", "statue", "plush", "keychain", "artbook", "art book", "faulty",
    "not working", "for parts", "spares or repairs", "spares repairs",
)
SOUNDTRACK_LEAD_INS = ("original", "official", "music", "game", "video", "promo")
SOUNDTRACK_WORDS = ("soundtrack", "soundtracks", "ost")
SOUNDTRACK_INCLUDED = (r"(?i)[+&]\s*(?:(?:the|a|an|bonus|original|official|music|game|video|promo|mini)\s+)*"
                       r"(?:soundtracks?|ost)\b")
COMES_WITH = r"(?:\bwith|\bw/|\+|&|\band|\bplus|\bincl\w*)\s*(?:[\w'’-]+\s+){0,3}"
OTHER_PLATFORMS = ("xbox", "gamecube", "dreamcast", "wii", "psp", "vita", "ps1", "psx", "ps3", "ps4", "ps5",
                   "nintendo switch", "pc dvd", "pc cd", "pc game")
IMPORT_PHRASES = ("japan", "japanese", "ntsc j", "jpn", "jp", "jap", "slpm", "slps", "scps")
GRADED_OR_SEALED = ("graded", "wata", "vga graded", "cgc", "ukg", "factory sealed", "sealed new", "still sealed",
                    "brand new sealed", "sealed brand new", "mint sealed", "sealed mint")
NOT_GRADED = ("not graded", "never graded")
INCOMPLETE_PHRASES = ("disc only", "disk only", "game only", "loose", "no manual", "no case", "no box", "no cover",
                      "no inlay", "missing manual", "without manual")
COMPLETE_PHRASES = ("complete", "cib", "boxed", "with manual", "manual included", "includes manual", "inc manual",
                    "with case", "with box", "case and manual", "box and manual")
CONSOLE_JUNK = (
    "for parts", "spares", "spares or repair", "spares or repairs", "for repair", "needs repair", "faulty",
    "not working", "broken", "untested", "modded", "modchip", "mod chip", "free mcboot", "fmcb", "skin", "sticker",
    "decal", "shell", "housing", "faceplate", "case only", "box only", "empty box", "manual only", "replica", "custom",
    "painted", "reproduction", "repro", "controller only", "no console", "job lot", "joblot", "stand only",
)
CONSOLE_PARTS = (
    "controller", "controllers", "dualshock", "joypad", "gamepad", "remote", "remote control", "power cord",
    "power cable", "power supply", "ac adapter", "adapter", "cable", "cables", "hdd", "hard drive", "pcb",
    "motherboard", "memory card",
)
CONSOLE_WORDS = ("console", "consoles", "system", "scph")
OTHER_CONSOLES = ("ps3", "ps4", "ps5", "psp", "ps vita", "xbox", "wii", "gamecube", "dreamcast", "nintendo switch")
FOREIGN = {
    "US": ("pal", "european", "sles", "sces"),
    "UK": ("ntsc", "usa", "us version", "slus", "scus"),
    "DE": ("ntsc", "usa", "us version", "us import", "slus", "scus"),
    "FR": ("ntsc", "usa", "us version", "us import", "slus", "scus"),
    "IT": ("ntsc", "usa", "us version", "us import", "slus", "scus"),
    "ES": ("ntsc", "usa", "us version", "us import", "slus", "scus"),
}
SITE_JUNK = {
    "DE": ("nur hulle", "nur cover", "nur anleitung", "nur booklet", "nur das cover", "nur die hulle", "leerhulle",
           "leere hulle", "leerverpackung", "ohne spiel", "ohne disc", "ohne cd", "ohne dvd", "ersatzhulle",
           "ersatzcover", "defekt", "kaputt", "bastler", "nicht funktionsfahig", "konvolut", "sammlung",
           "spielesammlung", "spielepaket", "restposten", "paket", "losungsbuch", "spieleberater", "kopie",
           "raubkopie", "nachdruck", "fanartikel", "figur", "plusch", "nachbau"),
    "FR": ("boite seule", "boitier seul", "notice seule", "livret seul", "jaquette seule", "coque seule", "sans jeu",
           "sans disque", "boitier vide", "boite vide", "defectueux", "en panne", "ne fonctionne pas", "hors service",
           "pour pieces", "collection", "guide officiel", "guide strategique", "solution complete", "copie",
           "figurine", "peluche"),
    "IT": ("solo scatola", "solo custodia", "solo manuale", "solo libretto", "solo copertina", "senza gioco",
           "senza disco", "custodia vuota", "scatola vuota", "difettoso", "non funzionante", "non funziona",
           "per ricambi", "per parti", "lotto", "stock", "collezione", "guida ufficiale", "guida strategica",
           "figura", "peluche"),
    "ES": ("solo caja", "solo carcasa", "solo manual", "solo funda", "solo portada", "sin juego", "sin disco",
           "caja vacia", "estuche vacio", "defectuoso", "roto", "no funciona", "para piezas", "para repuestos",
           "lote", "coleccion", "guia oficial", "guia estrategica", "replica", "figura", "peluche"),
}
SITE_INCOMPLETE = {
    "DE": ("ohne anleitung", "ohne ovp", "ohne hulle", "ohne cover", "ohne handbuch", "nur disc", "nur cd",
           "nur dvd", "nur spiel", "lose", "ohne box"),
    "FR": ("sans notice", "sans boite", "sans boitier", "sans jaquette", "sans livret", "disque seul", "jeu seul",
           "cd seul", "dvd seul", "loose"),
    "IT": ("senza manuale", "senza libretto", "senza custodia", "senza scatola", "senza copertina", "solo disco",
           "solo gioco", "solo cd", "sfuso"),
    "ES": ("sin manual", "sin caja", "sin estuche", "sin portada", "solo disco", "solo juego", "solo cd", "suelto"),
}
ONE_WORD_TITLES = (
    "airblade", "amplitude", "astroboy", "baroque", "beatmania", "bionicle", "bloodrayne", "bully", "burnout",
    "castleween", "catwoman", "chessmaster", "choroq", "chulip", "constantine", "coraline", "culdcept", "darkwatch",
    "drakengard", "equestriad", "eragon", "everblue", "evergrace", "fantavision", "fightbox", "flatout", "flipnic",
    "freekstyle", "frequency", "fruitfall", "futurama", "garfield", "genji", "getaway", "ghosthunter", "ghostmaster",
    "gladius", "godfather", "grimgrimoire", "gungrave", "headhunter", "heatseeker", "hobbit", "homura", "ico",
    "incredibles", "juiced", "jumanji", "kessen", "killzone", "kinetica", "kuon", "lemmings", "madagascar", "mafia",
    "manhunt", "maximo", "mercenaries", "metropolismania", "monopoly", "mummy", "nanobreaker", "okami",
    "psychonauts", "psyvariar", "punisher", "ratatouille", "rez", "robocop", "rocky", "scaler", "scarface", "shinobi",
    "siren", "skygunner", "splashdown", "spyhunter", "ssx", "stuntman", "suffering", "syberia", "tengai",
    "timesplitters", "trapt", "vexx", "xiii", "yakuza", "zathura", "zoocube",
)
EDITION_WORDS = (
    "directors", "cut", "special", "limited", "collectors", "edition", "greatest", "hits", "platinum", "the", "best",
    "premium", "pack", "bonus", "disc", "complete", "gold", "ultimate", "game", "of", "year", "classics",
    "essentials", "version",
)
BRAND_WORDS = ("the", "a", "an", "disney", "disneys", "pixar", "pixars", "marvel", "marvels", "nickelodeon", "ea",
               "sports", "sega", "capcom", "namco", "konami", "taito", "midway", "atari", "snk")
EXPANSION_WORDS = ("xtreme", "legends", "empires", "prologue", "expansion", "remix", "substance", "international",
                   "episode", "volume", "vol", "part")

# --- Fixed values: loose keys of titles -------------------------------------------------------------

LOOSE_SUBS = {"volume": "vol", "fuer": "for", "offroad": "off road", "disneys": "disney", "pixars": "pixar",
              "astroboy": "astro boy", "airforce": "air force", "beatdown": "beat down", "jr": "junior", "pes": ""}
LOOSE_PREFIXES = ("james bond", "snk", "disney pixar", "walt disney pictures presents", "walt disney", "disney",
                  "nickelodeon", "nick jr", "dreamworks", "eyetoy", "rtl", "sega sports", "ea sports", "project",
                  "jim hensons", "lara croft", "operative", "jet li", "shonen jumps")
LOOSE_PHRASES = (("fifa soccer", "fifa"), ("fifa football", "fifa"),
                 ("fifa fussball weltmeisterschaft", "fifa world cup"), ("mondiali fifa", "fifa world cup"),
                 ("mundial fifa", "fifa world cup"), ("coupe du monde fifa", "fifa world cup"))
LOOSE_TRAILING = r"\s+(?:sega sports|the game|the video game|video game|videogame|game)$"
LOOSE_STOP = ("the", "of", "and", "a", "in", "de", "to", "le", "la", "les", "der", "die", "das", "el", "fc", "vol")
SHORT_TYPO_WORDS = ("a", "o", "de", "of", "in", "s")
KEEP_APART = ("dark angel vampire apocalypse", "eyetoy play sports")
RELEASE_JUNK = r"(?i)\b(?:Beta|Demo|Proto|Prototype|Sample|Unl|Pirate|Promo|Kiosk|Bonus|Disc [2-9])\b"
US_RELEASE_TAGS = ("USA", "Canada", "USA, Canada")
PAL_RELEASE_TAGS = ("Europe", "UK", "Australia", "World")

# --- Fixed values: sampling of headlines ------------------------------------------------------------

COMMON_WORDS = (
    "the", "a", "an", "and", "of", "in", "on", "to", "for", "with", "black", "white", "red", "blue", "green", "gold",
    "silver", "war", "god", "king", "legend", "legends", "hero", "heroes", "fight", "fighter", "fighting", "night",
    "day", "time", "world", "life", "death", "dark", "light", "fire", "ice", "storm", "shadow", "shadows", "soul",
    "souls", "star", "stars", "sky", "land", "city", "state", "force", "forces", "club", "party", "max", "pro", "live",
    "online", "arena", "racing", "race", "rally", "run", "rush", "drive", "driver", "driven", "zone", "quest", "story",
    "stories", "destiny", "fate", "rising", "reborn", "origins", "evolution", "revolution",
)

# --- Fixed values: services and enums ---------------------------------------------------------------

SOURCE_TYPES = ("news", "reddit", "forum", "4chan", "youtube", "podcast")
CORE_TYPES = ("news", "reddit")
BOARD_TYPE = "4chan"
SOURCE_PREFIX = {"youtube": "YouTube: ", "podcast": "Podcast: ", "forum": "Forum: "}
REGIONS = ("US", "PAL")
CONDITIONS = ("sealed", "complete", "loose")
CURRENCIES = ("USD", "GBP", "EUR")
CHANNEL_ID = r"^UC[0-9A-Za-z_-]{22}$"
CHANNEL_URL = r"^https://www\.youtube\.com/(?:@|c/|user/)[^/?#\s]+$"
SUBREDDIT = r"^[A-Za-z0-9_]{2,21}$"
BOARD = r"^[a-z0-9]{1,6}$"
FEED_URL = r"^https?://(?:[A-Za-z0-9-]+\.)+[A-Za-z0-9-]+(?::[0-9]{1,5})?(?:[/?#][!-~]*)?$"
TITLE_HINT = (r"\b(?:ps2|ps\s?2|playstation\s?2|remaster(?:ed|s)?|remake|emulat\w*|hd\s+collection|retro|classic(?:s)?"
              r"|ps\s?plus|backwards?\s+compat\w*)\b")
ROMAN_IN_TITLE = r"\b(?:III|VIII|VII|VI|IV|IX|XII|XI|II|X|V)\b"
SAMPLE_QUOTAS = {"sequel": 0.22, "generic": 0.22, "near_miss": 0.25, "matched": 0.16, "unmatched": 0.15}
SAMPLE_MAX_PER_TITLE = 3
SAMPLE_MIN_CHARS = 20
FX_CURRENCIES = ("USD", "GBP", "PLN", "CHF")
FX_SANE = (0.01, 1000.0)

# --- Fixed values: genres ---------------------------------------------------------------------------

GENRE_BUCKETS = {
    "Action": "Action", "Platform": "Action", "Beat'em Up": "Fighting", "Fighting": "Fighting",
    "Wrestling": "Fighting", "Boxing": "Fighting", "Adventure": "Adventure", "Interactive Movie": "Adventure",
    "Visual Novel": "Adventure", "Survival Horror": "Horror", "Role-playing (RPG)": "RPG", "Racing": "Racing",
    "Shooter": "Shooter", "Gun": "Shooter", "Simulation": "Simulation", "Flight Simulator": "Simulation",
    "Strategy": "Strategy", "Sports": "Sports", "Tennis": "Sports", "Football": "Sports", "Basketball": "Sports",
    "Hunting and Fishing": "Sports", "Puzzle": "Puzzle & party", "Quiz": "Puzzle & party",
    "Mini Games": "Puzzle & party", "Board": "Puzzle & party", "Card": "Puzzle & party",
    "Gambling": "Puzzle & party", "Mahjong": "Puzzle & party", "Chess": "Puzzle & party",
    "Pinball": "Puzzle & party", "Breakout": "Puzzle & party", "Educational": "Puzzle & party",
    "Party": "Puzzle & party", "Music": "Music & dance", "Dancing": "Music & dance", "Sing": "Music & dance",
    "Rhythm": "Music & dance",
}
GENRE_KEYWORDS = (
    ("Horror", r"\b(?:silent hill|resident evil|biohazard|project zero|fatal frame|forbidden siren|siren"
               r"|haunting ground|rule of rose|obscure|clock tower|dead rising|cold fear|evil dead|stranger room"
               r"|call of cthulhu|hellboy)\b"),
    ("Music & dance", r"\b(?:singstar|sing star|karaoke|dance dance revolution|ddr|dancing|dance|guitar hero|rock band"
                      r"|rock revolution|taiko|drum|beatmania|para para|groove|buzz\b.*music|rhythm|amplitude"
                      r"|frequency|singing|disney sing)\b"),
    ("Sports", r"\b(?:fifa|pro evolution soccer|winning eleven|pes \d|uefa|football|soccer|nba|nhl|nfl|madden|mlb"
               r"|baseball|basketball|hockey|golf|tennis|rugby|cricket|snooker|pool|bowling|skate|skateboard"
               r"|tony hawk|snowboard|ski|surf|wwe|wrestling|smackdown|boxing|fight night|ufc|nascar|olympic|athletics"
               r"|fishing|bass|hunting|horse|polo|volleyball|tiger woods|world cup|euro 20|nba live|nba street|ncaa"
               r"|espn|fight club)\b"),
    ("Racing", r"\b(?:racing|racer|rally|gran turismo|need for speed|burnout|midnight club|ridge racer|wipeout|motogp"
               r"|moto gp|formula|f1|grand prix|drift|drifting|forza|driver|driving|kart|cars?\b|truck|atv|quad|offroad"
               r"|off road|wrc|colin mcrae|tokyo xtreme|street racer|toca|dirt|speed|nitro|hot wheels|burnout"
               r"|crash nitro|stuntman|test drive|gt legends|auto modellista|initial d|wangan|import tuner|juiced"
               r"|need for)\b"),
    ("Fighting", r"\b(?:tekken|mortal kombat|street fighter|virtua fighter|soulcalibur|soul calibur|dead or alive"
                 r"|king of fighters|guilty gear|blazblue|fighter|fighting|budokai|battle|bushido blade|bloody roar"
                 r"|capcom vs|marvel vs|samurai showdown|fatal fury|darkstalkers|tournament|arcana heart|melty blood"
                 r"|dragon ball|naruto|bleach|one piece|jump|knockout kings|def jam|rumble|brawl|martial|vs\.?"
                 r"|versus)\b"),
    ("RPG", r"\b(?:final fantasy|dragon quest|tales of|persona|shin megami|megami tensei|kingdom hearts|xenosaga"
            r"|star ocean|suikoden|dark cloud|dark chronicle|rogue galaxy|grandia|growlanser|valkyrie profile"
            r"|wild arms|ar tonelico|atelier|disgaea|phantom brave|okage|ys\b|baldur|neverwinter"
            r"|champions of norrath|everquest|rpg|odin sphere|legend of dragoon|breath of fire|digital devil"
            r"|devil summoner|cardinal|fantasy|dungeon|quest|saga|monster hunter|hack\b|dot hack|\.hack|radiata"
            r"|shadow hearts|lunar|arc the lad|tactics ogre|romancing|bahamut|magna carta|enchanted arms|gungnir"
            r"|resonance|tenchu)\b"),
    ("Shooter", r"\b(?:call of duty|medal of honor|socom|timesplitters|time splitters|halo|battlefield|killzone|black"
                r"|goldeneye|007|james bond|ghost recon|rainbow six|splinter cell|metal gear|syphon filter|spy hunter"
                r"|shooter|shooting|gun|guns|sniper|commando|soldier|war|army|marine|wolfenstein|doom|quake|half life"
                r"|unreal|red faction|conflict|delta force|operation|mercenaries|ghost|swat|crime|turok|area 51|bullet"
                r"|jackie chan|robotech|armored core|ace combat|raiden|r-type|gradius|gunbird|thunder|strikers"
                r"|dodonpachi|ikaruga|silpheed|1942|sky|zero wing|giga wing)\b"),
    ("Strategy", r"\b(?:strategy|tactics|civilization|age of empires|command and conquer|rts|total war"
                 r"|dynasty warriors tactics|romance of the three|nobunaga|sim city|simcity|railroad|tycoon|commandos"
                 r"|worms|advance wars|risk|kessen|battle realms|myth|rise of nations)\b"),
    ("Simulation", r"\b(?:simulator|simulation|sims|the sims|flight|farm|harvest moon|zoo|theme park|sim\b"
                   r"|gran turismo concept|train|rail|bus|airline|tycoon)\b"),
    ("Puzzle & party", r"\b(?:puzzle|puzzles|quiz|trivia|party|mahjong|shogi|chess|poker|casino|bingo|card|cards|board"
                       r"|monopoly|scrabble|pinball|mario party|buzz|eyetoy|family|minigame|mini game|tetris"
                       r"|bust a move|bubble|pac man|lumines|katamari|sudoku|crossword|who wants|millionaire"
                       r"|wheel of fortune|jeopardy|are you smarter|world quiz|kids|dora|spongebob|barbie|sesame"
                       r"|bob the builder|thomas|disney|pixar|shrek|cartoon)\b"),
    ("Adventure", r"\b(?:adventure|mystery|detective|sherlock|myst|syberia|broken sword|gabriel knight|phoenix wright"
                  r"|ace attorney|point and click|escape|ico|shadow of the colossus|okami|prince of persia|tomb raider"
                  r"|indiana jones|lara croft|uncharted|jak|ratchet|sly cooper|spyro|crash bandicoot|sonic|klonoa"
                  r"|rayman|psychonauts|mario|platform|hero|legend of|kuon|fahrenheit|indigo prophecy|beyond good"
                  r"|ghost master)\b"),
)

"""Phrases that the engine knows, word for word."""

# They must be these for results to match.

POLITE_FILLER = (
    "i hope this email finds you well",
    "i hope this message finds you well",
    "i hope this finds you well",
    "i hope you're doing well",
    "i hope you are doing well",
    "hope this email finds you well",
    "hope this finds you well",
    "i just wanted to reach out to you",
    "i just wanted to reach out",
    "i wanted to reach out",
    "i was wondering if you could please",
    "i was wondering if you could",
    "i was wondering if you would",
    "i was wondering whether you could",
    "i was wondering if",
    "i was wondering whether",
    "i would appreciate it if you could",
    "i would appreciate it if you would",
    "i would appreciate it if",
    "i would appreciate if",
    "i would be grateful if you could",
    "i would be grateful if",
    "would it be possible for you to",
    "would it be possible to",
    "is there any chance you could",
    "is there any possibility that",
    "i kindly request that you",
    "i would like to kindly",
    "i would like to please",
    "i would like to ask you to",
    "i would like to",
    "i'd like to ask you to",
    "i'd like to",
    "i am writing to you to",
    "i am writing to",
    "i'm writing to you to",
    "i'm writing to",
    "if it's not too much trouble",
    "if it is not too much trouble",
    "if you don't mind me asking",
    "if you do not mind me asking",
    "if you don't mind",
    "if you do not mind",
    "i hope you don't mind",
    "i hope you do not mind",
    "when you get a chance",
    "when you have a moment",
    "when you have a chance",
    "at your earliest convenience",
    "please feel free to",
    "please do not hesitate to",
    "please don't hesitate to",
    "do not hesitate to",
    "don't hesitate to",
    "would you be able to",
    "would you mind if i",
    "would you mind",
    "could you please",
    "can you please",
    "please could you",
    "please would you",
    "just wanted to let you know that",
    "just wanted to let you know",
    "wanted to let you know that",
    "just wanted to say",
    "just wanted to",
    "i just wanted to",
    "i just wanted",
    "thank you in advance for your",
    "thank you in advance for",
    "thank you in advance",
    "thanks in advance for your",
    "thanks in advance",
    "looking forward to hearing from you",
    "looking forward to your response",
    "i look forward to hearing from you",
    "it would be greatly appreciated if",
    "it would be greatly appreciated",
    "it would be appreciated if",
    "it would be appreciated",
    "sorry to bother you but",
    "sorry to bother you",
    "sorry for bothering you",
    "sorry for the inconvenience",
    "i apologize for the inconvenience",
    "pardon me for asking",
    "to whom it may concern",
    "for your information",
    "as per my last email",
    "as per our conversation",
    "if at all possible",
    "if you would be so kind as to",
    "if you would be so kind",
    "kindly please",
)

STRICT_FILLER = (
    "let me know if you have any questions",
    "let me know if you need anything else",
    "let me know if you need anything",
    "let me know if that makes sense",
    "please let me know if you have any questions",
    "it is important to note that",
    "it is important to note",
    "it is worth noting that",
    "it is worth mentioning that",
    "it should be noted that",
    "it should be pointed out that",
    "it is interesting to note that",
    "it goes without saying that",
    "it goes without saying",
    "needless to say that",
    "needless to say",
    "it is clear that",
    "it is obvious that",
    "it is evident that",
    "there is no doubt that",
    "there is no question that",
    "please be advised that",
    "please note that",
    "for what it's worth",
    "for what it is worth",
    "to be perfectly honest",
    "to be honest with you",
    "to be honest",
    "to tell you the truth",
    "to tell the truth",
    "if i may say so",
    "if i may",
    "if you will",
    "as a matter of fact",
    "all things considered",
    "at the end of the day",
    "the bottom line is that",
    "the bottom line is",
    "with all due respect",
    "if that makes sense",
    "does that make sense",
    "just a heads up that",
    "just a heads up",
    "heads up that",
    "as you may or may not know",
    "as you may know",
    "as you know",
    "as i mentioned above",
    "as i mentioned earlier",
    "as i mentioned",
    "as mentioned above",
    "as mentioned earlier",
    "as mentioned",
    "like i said",
    "as i said",
    "you know what i mean",
    "if you know what i mean",
    "i mean",
    "you know",
    "by the way",
    "feel free to",
    "in this particular case",
    "in this particular instance",
    "in the process of",
    "for all intents and purposes",
    "it is my opinion that",
    "i am of the opinion that",
    "in my personal opinion",
    "in my humble opinion",
    "in my opinion",
    "from my perspective",
    "the possibility exists that",
    "there is a possibility that",
)

HEDGES = (
    "more or less",
    "sort of",
    "kind of",
    "kinda",
    "sorta",
    "a bit",
    "a little bit",
    "i think that",
    "i think",
    "i believe that",
    "i believe",
    "i feel like",
    "it seems like",
    "it seems that",
    "it seems",
    "it appears that",
    "it appears",
    "basically",
    "actually",
    "literally",
    "honestly",
    "seriously",
    "really",
    "very",
    "quite",
    "rather",
    "somewhat",
    "perhaps",
    "maybe",
    "probably",
    "possibly",
    "arguably",
    "presumably",
    "supposedly",
    "apparently",
    "essentially",
    "relatively",
    "fairly",
    "just",
)

COLLAPSES = (
    ("in spite of the fact that", "although"),
    ("despite the fact that", "although"),
    ("regardless of the fact that", "although"),
    ("notwithstanding the fact that", "although"),
    ("owing to the fact that", "because"),
    ("due to the fact that", "because"),
    ("on account of the fact that", "because"),
    ("in light of the fact that", "because"),
    ("in view of the fact that", "because"),
    ("given the fact that", "because"),
    ("for the reason that", "because"),
    ("as a consequence of", "because"),
    ("as a result of", "because"),
    ("the fact that", "that"),
    ("for the purpose of", "to"),
    ("in order that", "so"),
    ("in order for", "for"),
    ("in order to", "to"),
    ("so as to", "to"),
    ("with the aim of", "to"),
    ("in the event that", "if"),
    ("in the event of", "if"),
    ("in case of", "if"),
    ("the question as to whether", "whether"),
    ("whether or not", "whether"),
    ("as to whether", "whether"),
    ("at this moment in time", "now"),
    ("at this point in time", "now"),
    ("at the present moment", "now"),
    ("at the present time", "now"),
    ("at this time", "now"),
    ("at present", "now"),
    ("in this day and age", "today"),
    ("in the not too distant future", "soon"),
    ("in the near future", "soon"),
    ("as soon as possible", "ASAP"),
    ("until such time as", "until"),
    ("during the course of", "during"),
    ("in the course of", "during"),
    ("in close proximity to", "near"),
    ("in the vicinity of", "near"),
    ("prior to", "before"),
    ("subsequent to", "after"),
    ("in conjunction with", "with"),
    ("in combination with", "with"),
    ("with the exception of", "except"),
    ("in addition to", "besides"),
    ("as well as", "and"),
    ("in terms of", "regarding"),
    ("with regard to", "regarding"),
    ("with regards to", "regarding"),
    ("with respect to", "regarding"),
    ("in respect of", "regarding"),
    ("in relation to", "about"),
    ("pertaining to", "about"),
    ("with reference to", "regarding"),
    ("in connection with", "about"),
    ("in accordance with", "per"),
    ("by means of", "by"),
    ("by virtue of", "by"),
    ("on the part of", "by"),
    ("in the absence of", "without"),
    ("in the presence of", "with"),
    ("a large number of", "many"),
    ("a great number of", "many"),
    ("a large amount of", "much"),
    ("a great deal of", "much"),
    ("a wide range of", "many"),
    ("the vast majority of", "most"),
    ("a majority of", "most"),
    ("the majority of", "most"),
    ("a number of", "several"),
    ("a variety of", "various"),
    ("has the ability to", "can"),
    ("have the ability to", "can"),
    ("has the capacity to", "can"),
    ("is able to", "can"),
    ("are able to", "can"),
    ("is capable of", "can"),
    ("make a decision", "decide"),
    ("come to a conclusion", "conclude"),
    ("reach a conclusion", "conclude"),
    ("take into consideration", "consider"),
    ("take into account", "consider"),
    ("give consideration to", "consider"),
    ("perform an analysis of", "analyze"),
    ("make use of", "use"),
    ("is going to", "will"),
    ("are going to", "will"),
    ("on a regular basis", "regularly"),
    ("on a daily basis", "daily"),
    ("on a weekly basis", "weekly"),
    ("in a timely manner", "promptly"),
    ("it is necessary to", "must"),
    ("it is possible to", "can"),
    ("there is a need to", "must"),
    ("in the majority of cases", "usually"),
    ("in most cases", "usually"),
    ("in some cases", "sometimes"),
    ("in all cases", "always"),
    ("at all times", "always"),
    ("on the other hand", "however"),
    ("at the same time", "simultaneously"),
    ("in the same way", "similarly"),
    ("in a similar fashion", "similarly"),
    ("in a similar manner", "similarly"),
    ("for the most part", "mostly"),
    ("to a large extent", "largely"),
    ("to some extent", "partly"),
    ("all of a sudden", "suddenly"),
    ("once in a while", "occasionally"),
    ("from time to time", "occasionally"),
    ("every now and then", "occasionally"),
    ("in the long run", "eventually"),
    ("sooner or later", "eventually"),
    ("each and every", "every"),
    ("first and foremost", "first"),
    ("last but not least", "finally"),
    ("over and over again", "repeatedly"),
    ("again and again", "repeatedly"),
    ("time and time again", "repeatedly"),
    ("the end result", "the result"),
    ("end result", "result"),
    ("final outcome", "outcome"),
    ("future plans", "plans"),
    ("past history", "history"),
    ("unexpected surprise", "surprise"),
    ("absolutely essential", "essential"),
    ("completely eliminate", "eliminate"),
    ("advance planning", "planning"),
    ("new innovation", "innovation"),
    ("true fact", "fact"),
    ("basic fundamentals", "fundamentals"),
    ("close proximity", "proximity"),
    ("join together", "join"),
    ("revert back", "revert"),
    ("return back", "return"),
    ("still remain", "remain"),
    ("completely finish", "finish"),
    ("exactly the same", "the same"),
    ("various different", "various"),
    ("each individual", "each"),
    ("the reason why", "the reason"),
    ("period of time", "period"),
    ("point in time", "time"),
    ("small in size", "small"),
    ("large in size", "large"),
    ("few in number", "few"),
    ("general consensus", "consensus"),
    ("added bonus", "bonus"),
    ("crisis situation", "crisis"),
    ("had an effect on", "affected"),
    ("had an impact on", "affected"),
    ("in the middle of", "during"),
    ("under the circumstances", "given this"),
    ("atm machine", "ATM"),
    ("pin number", "PIN"),
    ("isbn number", "ISBN"),
    ("vin number", "VIN"),
    ("hiv virus", "HIV"),
    ("lcd display", "LCD"),
    ("ram memory", "RAM"),
    ("gps system", "GPS"),
    ("upc code", "UPC"),
    ("completely unique", "unique"),
    ("totally unique", "unique"),
    ("absolutely unique", "unique"),
    ("absolutely necessary", "necessary"),
    ("free gift", "gift"),
    ("actual fact", "fact"),
    ("honest truth", "truth"),
    ("assemble together", "assemble"),
    ("merge together", "merge"),
    ("combine together", "combine"),
    ("repeat again", "repeat"),
    ("recur again", "recur"),
    ("refer back", "refer"),
    ("reply back", "reply"),
    ("plan ahead", "plan"),
    ("postpone until later", "postpone"),
    ("descend down", "descend"),
    ("rise up", "rise"),
    ("sum total", "total"),
    ("invited guests", "guests"),
    ("regular routine", "routine"),
    ("new beginning", "beginning"),
    ("first began", "began"),
    ("advance warning", "warning"),
    ("current status", "status"),
    ("frozen ice", "ice"),
    ("round circle", "circle"),
    ("exact replica", "replica"),
    ("exact same", "same"),
    ("same exact", "same"),
    ("inner core", "core"),
    ("old adage", "adage"),
    ("passing fad", "fad"),
    ("serious crisis", "crisis"),
    ("still continues", "continues"),
    ("sudden surprise", "surprise"),
    ("unexpected emergency", "emergency"),
    ("annual anniversary", "anniversary"),
    ("foreign import", "import"),
    ("consensus of opinion", "consensus"),
    ("completely unanimous", "unanimous"),
    ("completely full", "full"),
    ("brief moment", "moment"),
    ("component parts", "parts"),
    ("visible to the eye", "visible"),
    ("warn in advance", "warn"),
    ("evolve over time", "evolve"),
    ("surrounded on all sides", "surrounded"),
    ("ultimate goal", "goal"),
)

CONTRACTIONS = (
    ("must not", "mustn't"),
    ("might not", "mightn't"),
    ("need not", "needn't"),
    ("does not", "doesn't"),
    ("did not", "didn't"),
    ("was not", "wasn't"),
    ("were not", "weren't"),
    ("have not", "haven't"),
    ("has not", "hasn't"),
    ("had not", "hadn't"),
    ("will not", "won't"),
    ("would not", "wouldn't"),
    ("could not", "couldn't"),
    ("should not", "shouldn't"),
    ("do not", "don't"),
    ("is not", "isn't"),
    ("are not", "aren't"),
    ("can not", "can't"),
    ("cannot", "can't"),
    ("they would", "they'd"),
    ("they will", "they'll"),
    ("they have", "they've"),
    ("they are", "they're"),
    ("you would", "you'd"),
    ("you will", "you'll"),
    ("you have", "you've"),
    ("you are", "you're"),
    ("she would", "she'd"),
    ("she will", "she'll"),
    ("she has", "she's"),
    ("she is", "she's"),
    ("he would", "he'd"),
    ("he will", "he'll"),
    ("he has", "he's"),
    ("he is", "he's"),
    ("we would", "we'd"),
    ("we will", "we'll"),
    ("we have", "we've"),
    ("we are", "we're"),
    ("i would", "i'd"),
    ("i will", "i'll"),
    ("i have", "i've"),
    ("i am", "i'm"),
    ("that would", "that'd"),
    ("that will", "that'll"),
    ("that has", "that's"),
    ("that is", "that's"),
    ("there would", "there'd"),
    ("there will", "there'll"),
    ("there has", "there's"),
    ("there is", "there's"),
    ("what would", "what'd"),
    ("what will", "what'll"),
    ("what has", "what's"),
    ("what is", "what's"),
    ("who would", "who'd"),
    ("who will", "who'll"),
    ("who has", "who's"),
    ("who is", "who's"),
    ("where is", "where's"),
    ("when is", "when's"),
    ("how is", "how's"),
    ("here is", "here's"),
    ("it would", "it'd"),
    ("it will", "it'll"),
    ("it has", "it's"),
    ("it is", "it's"),
    ("let us", "let's"),
)

ABBREVIATIONS = (
    ("that is to say", "i.e."),
    ("for example", "e.g."),
    ("for instance", "e.g."),
    ("in other words", "i.e."),
    ("and so forth.", "etc."),
    ("and so forth", "etc."),
    ("and so on.", "etc."),
    ("and so on", "etc."),
    ("et cetera.", "etc."),
    ("et cetera", "etc."),
    ("versus", "vs"),
    ("vs.", "vs"),
)

ARTICLES = (
    "the",
    "an",
    "a",
)

ASIDES = (
    "as mentioned earlier",
    "as mentioned above",
    "as i mentioned earlier",
    "as i mentioned above",
    "as i mentioned",
    "as mentioned",
    "as noted earlier",
    "as noted above",
    "as noted",
    "as discussed earlier",
    "as discussed above",
    "needless to say",
    "to be honest",
    "to be fair",
    "as you know",
    "as i said",
    "like i said",
    "by the way",
    "see above",
    "see below",
    "emphasis mine",
    "emphasis added",
    "so to speak",
    "as it were",
    "if you will",
    "of course",
    "you know",
    "btw",
    "anyway",
    "anyways",
    "however",
    "though",
    "incidentally",
    "meanwhile",
    "obviously",
    "clearly",
)

SENTENCE_ABBREVIATIONS = (
    "mr",
    "mrs",
    "ms",
    "dr",
    "prof",
    "sr",
    "jr",
    "st",
    "vs",
    "etc",
    "inc",
    "ltd",
    "corp",
    "co",
    "al",
    "fig",
    "eq",
    "no",
    "vol",
    "pp",
    "pg",
    "approx",
    "est",
    "dept",
    "univ",
    "jan",
    "feb",
    "mar",
    "apr",
    "jun",
    "jul",
    "aug",
    "sep",
    "sept",
    "oct",
    "nov",
    "dec",
    "mon",
    "tue",
    "wed",
    "thu",
    "fri",
    "sat",
    "sun",
    "e.g",
    "i.e",
    "u.s",
    "u.k",
    "ph.d",
)

STOPWORDS = frozenset(
    (
        "a",
        "an",
        "the",
        "and",
        "or",
        "but",
        "if",
        "while",
        "as",
        "of",
        "at",
        "by",
        "for",
        "with",
        "about",
        "against",
        "between",
        "into",
        "through",
        "during",
        "before",
        "after",
        "above",
        "below",
        "to",
        "from",
        "up",
        "down",
        "in",
        "out",
        "on",
        "off",
        "over",
        "under",
        "again",
        "further",
        "then",
        "once",
        "here",
        "there",
        "when",
        "where",
        "why",
        "how",
        "all",
        "both",
        "each",
        "few",
        "more",
        "most",
        "other",
        "some",
        "such",
        "only",
        "own",
        "same",
        "so",
        "than",
        "too",
        "very",
        "can",
        "will",
        "just",
        "should",
        "now",
        "i",
        "me",
        "my",
        "myself",
        "we",
        "our",
        "ours",
        "ourselves",
        "you",
        "your",
        "yours",
        "yourself",
        "yourselves",
        "he",
        "him",
        "his",
        "himself",
        "she",
        "her",
        "hers",
        "herself",
        "it",
        "its",
        "itself",
        "they",
        "them",
        "their",
        "theirs",
        "themselves",
        "what",
        "which",
        "who",
        "whom",
        "this",
        "that",
        "these",
        "those",
        "am",
        "is",
        "are",
        "was",
        "were",
        "be",
        "been",
        "being",
        "have",
        "has",
        "had",
        "having",
        "do",
        "does",
        "did",
        "doing",
        "would",
        "could",
        "might",
        "must",
        "shall",
        "also",
        "however",
        "therefore",
        "thus",
        "hence",
        "indeed",
        "still",
        "already",
        "yet",
        "even",
        "ever",
        "always",
        "often",
        "sometimes",
        "usually",
        "really",
        "actually",
        "basically",
        "literally",
        "perhaps",
        "maybe",
        "probably",
        "quite",
        "rather",
        "almost",
        "enough",
        "among",
        "within",
        "without",
        "along",
        "across",
        "behind",
        "beyond",
        "plus",
        "per",
        "via",
        "vs",
        "etc",
        "ie",
        "eg",
    )
)

"""What a corpus is tagged with: families by pattern and by keyword, signals, and the orders that break ties."""

from __future__ import annotations

from dataclasses import dataclass, field

OTHER = "other"


@dataclass(frozen=True)
class Taxonomy:
    """All of it is data: another corpus takes another instance.

    ``patterns`` are (family, alternatives) matched as whole words; ``keywords`` and ``signals`` are matched as plain
    substrings; ``severity`` ranks families, worst first; ``priority`` breaks ties of hit counts. Hits are counted of
    ``hit_keywords``, where they are given, else of ``keywords``.
    """

    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    keywords: dict[str, tuple[str, ...]] = field(default_factory=dict)
    signals: dict[str, tuple[str, ...]] = field(default_factory=dict)
    severity: tuple[str, ...] = ()
    priority: tuple[str, ...] = ()
    labels: dict[str, str] = field(default_factory=dict)
    hit_keywords: dict[str, tuple[str, ...]] | None = None

    def counted(self) -> dict[str, tuple[str, ...]]:
        return self.keywords if self.hit_keywords is None else self.hit_keywords

    def keyword_rows(self) -> list[tuple[str, str]]:
        return [(k.strip().lower(), f.strip()) for f, ks in self.keywords.items() for k in ks]

    def signal_rows(self) -> list[tuple[str, str]]:
        return [(k.strip().lower(), c.strip()) for c, ks in self.signals.items() for k in ks]


def _lists(text: str) -> dict[str, tuple[str, ...]]:
    rows = [line.split(": ", 1) for line in text.strip().splitlines()]
    return {name.strip(): tuple(x.strip() for x in values.split(",")) for name, values in rows}


# The default taxonomy's keywords by family.
KEYWORDS = _lists("""
money_laundering: shell company, shell companies, shell corporation, front company, money mule, mule account, layering, structuring, smurfing, placement, beneficial owner
check_fraud: check fraud, mail theft, stolen check, stolen checks, check washing, fraudulent check, altered check, forged check
sanctions: sanctions evasion, sanctioned entity, export control violation
terrorist_financing: terrorist financing, terrorist organization
human_trafficking: human trafficking, labor trafficking
consumer_fraud: romance scam, lottery scam, charity fraud, investment scam, scam, fraudster, gift card scam, imposter scam, advance fee, government impersonator, business impersonator
identity_fraud: identity theft, stolen identity, synthetic identity, account takeover, identity document, credential theft, ssn
benefits_fraud: government benefits fraud, medicaid fraud, pandemic relief fraud, unemployment fraud
cybercrime: ransomware, phishing, smishing, vishing, malware, data breach, credential stuffing, social engineering, business email compromise, bec, spear phishing, dark web
crypto_fraud: virtual currency, cryptocurrency, crypto exchange, crypto wallet, pig butchering, wallet address, bitcoin, ethereum, rug pull, wallet
data_privacy: personal data, coppa, privacy rule, privacy violation, unauthorized disclosure, sensitive data, pii, data protection, personally identifiable
ai_fraud: prompt injection, deepfake, ai scam, ai-generated fraud, llm exploit, ai recommendation poisoning, hidden prompt, generative ai fraud
drug_trafficking: fentanyl, narcotic, cocaine, heroin, opioid, drug distribution, drug trafficking, controlled substance
securities_fraud: ponzi, investment fraud, securities fraud, hedge fund fraud, stock manipulation, insider trading, pyramid scheme, unregistered securities
""")

# The default taxonomy's whole-word patterns by family.
PATTERNS = _lists("""
money_laundering: shell company, shell companies, front company, money mule, mule account, layering, structuring, smurfing, beneficial owner
check_fraud: check fraud, mail theft, stolen check, stolen checks, check washing, fraudulent check, altered check, forged check
sanctions: sanctions evasion, sanctioned entity, export control violation
terrorist_financing: terrorist financing, terrorist organization
human_trafficking: human trafficking, labor trafficking
consumer_fraud: romance scam, lottery scam, charity fraud, investment scam, advance fee, imposter, government impersonator, gift card scam, scam, fraudster
identity_fraud: identity theft, stolen identity, synthetic identity, ssn, account takeover, credential theft
benefits_fraud: government benefits fraud, medicaid fraud, pandemic relief fraud, unemployment fraud
cybercrime: ransomware, phishing, smishing, vishing, malware, data breach, business email compromise, bec, spear phishing, dark web, credential stuffing, social engineering
crypto_fraud: virtual currency, cryptocurrency, crypto exchange, pig butchering, crypto, bitcoin, ethereum, wallet address, rug pull, crypto wallet
data_privacy: personal data, coppa, privacy rule, privacy violation, unauthorized disclosure, sensitive data, pii, data protection, personally identifiable
ai_fraud: prompt injection, deepfake, ai scam, ai-generated fraud, llm exploit, ai recommendation poisoning, hidden prompt, generative ai fraud
drug_trafficking: fentanyl, narcotic, cocaine, heroin, opioid, drug distribution, drug trafficking, controlled substance
securities_fraud: ponzi, investment fraud, securities fraud, hedge fund fraud, stock manipulation, insider trading, pyramid scheme, unregistered securities
""")

# The default taxonomy's signals by category.
SIGNALS = _lists("""
entity_signal: shell company, shell companies, front company
ownership_signal: beneficial owner, ultimate beneficial owner, ubo
transaction_signal: money mule, money mules, mule account, layering, structuring, smurfing, round dollar transactions, rapid movement of funds
payment_signal: wire transfer, international wire, cash withdrawal, atm withdrawal, prepaid card, gift card, zelle, venmo, cash app, paypal, peer-to-peer payment, p2p payment
crypto_signal: cryptocurrency, virtual currency, crypto exchange, crypto wallet, digital wallet, wallet address, bitcoin address, ethereum address, pig butchering, rug pull
identity_signal: identity theft, stolen identity, synthetic identity, account takeover, credential theft, compromised account, unauthorized access
cyber_signal: phishing, smishing, vishing, malware, ransomware, data breach, credential stuffing, social engineering, remote access, trojan
document_signal: false claim, false claims, fraudulent invoice, fake documentation, forged document, fabricated records
scam_signal: imposter, impersonation, romance scam, investment scam, lottery scam, gift card scam, advance fee, urgent payment request
contact_signal: email address, phone number, text message, sms message, telegram, whatsapp
""")

# Severity, worst first, and the order that breaks ties of hit counts.
SEVERITY = ("terrorist_financing", "human_trafficking", "drug_trafficking", "money_laundering", "sanctions", "securities_fraud", "crypto_fraud", "cybercrime", "ai_fraud", "check_fraud", "identity_fraud", "consumer_fraud", "benefits_fraud", "data_privacy", "other")
PRIORITY = ("terrorist_financing", "human_trafficking", "sanctions", "money_laundering", "crypto_fraud", "cybercrime", "identity_fraud", "consumer_fraud", "check_fraud", "benefits_fraud", "other")

LABELS = {f: f.replace("_", " ").title() for f in KEYWORDS} | {"sanctions": "Sanctions Evasion", "ai_fraud": "AI Fraud", OTHER: "Other / Unclassified"}

# The earlier edition's keywords by family; hit counts for primary tags go by these.
EARLIER_KEYWORDS = _lists("""
money_laundering: shell company, shell companies, shell corporation, front company, money mule, mule account, layering, structuring, smurfing, placement, beneficial owner
check_fraud: check fraud, mail theft, stolen check, stolen checks, check washing, fraudulent check, altered check, forged check
sanctions: sanctions evasion, sanctioned entity, export control violation
terrorist_financing: terrorist financing, terrorist organization
human_trafficking: human trafficking, labor trafficking
consumer_fraud: romance scam, lottery scam, charity fraud, investment scam, scam, fraudster, gift card scam, imposter scam
identity_fraud: identity theft, stolen identity, synthetic identity, account takeover, identity document, credential theft
benefits_fraud: government benefits fraud, medicaid fraud, pandemic relief fraud
cybercrime: ransomware, phishing, malware, data breach, credential stuffing, social engineering
crypto_fraud: virtual currency, cryptocurrency, crypto exchange, pig butchering, wallet, crypto wallet, rug pull
""")

# The earlier edition's whole-word patterns by family, in the order in which tags are listed.
EARLIER_PATTERNS = _lists("""
money_laundering: shell company, shell companies, front company, money mule, mule account, layering, structuring
check_fraud: check fraud, mail theft, stolen check, stolen checks, check washing, fraudulent check, altered check, forged check
sanctions: sanctions evasion, sanctioned entity, export control violation
terrorist_financing: terrorist financing, terrorist organization
human_trafficking: human trafficking, labor trafficking
consumer_fraud: romance scam, lottery scam, charity fraud, investment scam, advance fee, imposter, government impersonator, business impersonator
identity_fraud: identity theft, stolen identity, synthetic identity, ssn, account takeover
benefits_fraud: government benefits fraud, medicaid fraud, pandemic relief fraud, unemployment fraud
cybercrime: ransomware, phishing, smishing, malware, business email compromise, bec, spear phishing, dark web
crypto_fraud: virtual currency, cryptocurrency, crypto exchange, pig butchering, crypto, bitcoin, ethereum, wallet address
""")

DEFAULT = Taxonomy(PATTERNS, KEYWORDS, SIGNALS, SEVERITY, PRIORITY, LABELS, EARLIER_KEYWORDS)

#: The earlier edition: ten families, fewer keywords and narrower patterns.
EARLIER = Taxonomy(EARLIER_PATTERNS, EARLIER_KEYWORDS, SIGNALS, SEVERITY, PRIORITY, LABELS)

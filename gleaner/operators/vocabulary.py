"""The planner's word lists and patterns, on folded text. A trailing * allows any ending."""

from __future__ import annotations

SOFTWARE_TERMS = (
    "generic_connector", "logiciel de gestion hôtelière", "software", "logiciel", "bouton", "menu", "section", "onglet", "ecran", "cliquer",
    "formulaire", "planning", "software", "button", "screen", "tab", "hotel management software",
)
HOTEL_TERMS = (
    "hotel", "reception", "client", "chambre", "sejour", "caution", "responsable", "bruit", "climatisation", "visiteur", "passant", "agress*",
    "ivresse", "urgence", "police",
)
POLICY_TERMS = (
    "accept*", "autoris*", "a le droit", "avons nous le droit", "peut*", "pouv*", "est ce que on peut", "combien", "tarif", "politique",
    "condition", "droit", "autorisation",
)
SENSITIVE_TERMS = (
    "paiement", "payer", "carte*", "debit", "preautorisation", "remboursement", "facturer", "facturation", "caution", "garantie", "agress*",
    "danger", "urgence", "police", "securite",
)
SUPPORT_TERMS = (
    "droit", "autoris*", "accept*", "peut*", "pouv*", "est ce que on peut", "avant l arrivee", "apres l arrivee", "avant le check in",
    "sans accord", "carte jointe", "carte enregistree",
)
PROCEDURE_TERMS = ("bouton", "section", "onglet", "menu", "etape", "guider")
REFERENCES = (
    r"(?:ces?\s+modific\w*|ces?\s+changements?|cette\s+operation|cela|ca|le\s+faire|la\s+faire|les\s+faire|faire\s+ca|faire\s+cela|"
    r"comme\s+avant|comme\s+indique|pareil|et\s+ensuite)"
)
ALIASES = (
    (r"check[ -]?in", "effectuer un check-in reservation"),
    (r"check[ -]?out", "effectuer un check-out reservation facturation integralite"),
    (r"liens?\s+(?:de\s+)?paiement", "creer un lien securise paiement 3D Secure type de lien email client"),
    (
        r"(?:ajouter|ajout\w*|enregistrer|facturer)\s+(?:des?|le|la|un|une)?\s*(?:extras?|prestations?\s+complementaires?|supplements?)",
        "bouton bleu ajout de prestation complementaire choisir date extra quantite ajouter les extras selectionnes",
    ),
    (r"(?:cb|cartes?\s+bleues?)", "carte bancaire paiement par carte moyen de paiement accepte accepter le paiement par carte ou en especes"),
    (
        r"(?:clim(?:atisation)?|air\s+conditionne)",
        "climatisation panne technique changer le client de chambre deplacer une reservation d'une chambre a une autre en cours de sejour "
        "planning attribution de chambre",
    ),
    (r"cheques?\s+vacances?", "cheque-vacances ANCV moyen de paiement"),
    (r"(?:passant|personne\s+de\s+la\s+rue)", "personne exterieure visiteur exterieur incident de securite"),
    (r"(?:ivre|bourre|ivresse)", "ivresse comportement agressif risque pour la securite"),
    (r"rajouter", "ajouter"),
)
BOTH_STEPS = r"(?:et|puis)\s+comment"
DIFFERENCE = r"(?:difference|qu est ce)"
OUTSIDER = r"(?:passant|personne\s+exterieure|personne\s+de\s+la\s+rue)"
NOISE = r"(?:bruit|nuisance\s+sonore)"
PREVIOUS, CURRENT, EQUIVALENTS = "Demande précédente : ", "Demande actuelle : ", "Termes équivalents utiles : "

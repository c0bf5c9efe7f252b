"""The taxonomy, the ordered rules that assign it, and the planner's word lists."""

from __future__ import annotations

#: Domain -> topic -> subtopics.
TAXONOMY: dict[str, dict[str, tuple[str, ...]]] = {
    "software": {
        "general": (),
        "reservations": ("create_reservation", "search_reservation", "modify_reservation", "cancel_reservation", "change_dates", "room_assignment", "notes",),
        "check_in_check_out": ("check_in", "check_out", "no_show", "late_arrival",),
        "payments": ("payment", "deposit", "refund", "vcc", "ota_payment",),
        "billing": ("invoice", "company_invoice", "split_invoice", "modify_invoice",),
        "planning": (),
        "reports": (),
        "rooms": (),
        "guests": (),
        "users": (),
        "settings": (),
    },
    "hotel": {
        "guest_journey": ("check_in", "check_out", "early_check_in", "late_check_out", "luggage", "visitors",),
        "payments": ("deposit", "refund", "cash", "card_rejected", "ota", "invoice", "payment_dispute",),
        "reservations": ("cancellation", "modification", "no_show", "walk_in", "overbooking", "room_change",),
        "services": ("breakfast", "wifi", "taxis", "luggage", "amenities",),
        "incidents": ("key_card", "wifi", "air_conditioning", "heating", "television", "room_issue",),
        "complaints": ("noise", "cleanliness", "equipment", "room_condition",),
        "night_reception": ("late_arrivals", "night_tasks", "daily_closure", "next_day_preparation",),
        "escalation": ("who_to_contact", "when_to_call_manager", "emergency_procedures",),
    },
}

#: Fixed values: (topic, subtopic, phrases), the first match counts.
SOFTWARE_RULES: tuple[tuple[str, str | None, tuple[str, ...]], ...] = (
    ("billing", "modify_invoice", ("avoir", "annuler une facture", "modifier une facture", "annuler du chiffre d affaires")),
    ("billing", "split_invoice", ("scinder une facture", "factures individuelles", "split invoice")),
    ("billing", "company_invoice", ("facture entreprise", "facture societe", "company invoice")),
    ("check_in_check_out", "no_show", ("no show",)),
    ("check_in_check_out", "late_arrival", ("arrivee tardive",)),
    ("check_in_check_out", "check_in", ("check in", "enregistrer une arrivee")),
    ("check_in_check_out", "check_out", ("check out", "depart anticipe", "enregistrer un depart")),
    ("reservations", "cancel_reservation", ("annuler une reservation", "annulation tardive", "conditions d annulation")),
    ("reservations", "change_dates", ("changer les dates", "modifier les dates")),
    ("reservations", "room_assignment", ("attribuer une chambre", "de attribuer", "deplacer une reservation")),
    ("reservations", "search_reservation", ("rechercher une reservation", "retrouver un dossier")),
    ("reservations", "create_reservation", ("creer un dossier", "creer une reservation", "dossier groupe")),
    ("reservations", "modify_reservation", ("modifier une reservation", "modifier les informations d un dossier")),
    ("reservations", "notes", ("note dossier", "remarque dossier")),
    ("users", None, ("utilisateur", "profil utilisateur", "droits des profils")),
    ("reports", None, ("rapport", "reporting", "statistique", "cloture journaliere", "rapprochement bancaire", "retrouver le chiffre d affaires", "ca genere")),
    ("guests", None, ("fichier client", "cardex", "clientele")),
    ("rooms", None, ("planning menage", "menage", "ouvrir et fermer des chambres", "chambre communicante")),
    ("planning", None, ("planning journalier", "planning des connectivites", "evenement planning")),
    ("settings", None, ("parametrage", "configuration", "plan tarifaire", "grille de tarifs", "code promotion", "booking engine", "stock", "extra", "option", "modele d email", "acces cb", "agence")),
    ("payments", "vcc", ("vcc", "carte virtuelle")),
    ("payments", "ota_payment", ("paiement ota", "plateforme reservation", "plateforme reservation")),
    ("payments", "refund", ("remboursement", "rembourser")),
    ("payments", "deposit", ("acompte", "arrhes", "caution", "garantie")),
    ("payments", "payment", ("reglement", "paiement", "carte bancaire", "caisse", "tpe")),
    ("billing", "invoice", ("facture", "facturation", "tva")),
    ("reservations", None, ("reservation", "dossier")),
)

#: A hotel card's subtopic -> (topic, subtopic).
HOTEL_SUBTOPICS: dict[str, tuple[str, str]] = {
    "standard_checkin": ("guest_journey", "check_in"),
    "standard_checkout": ("guest_journey", "check_out"),
    "early_checkin": ("guest_journey", "early_check_in"),
    "late_checkout": ("guest_journey", "late_check_out"),
    "luggage_storage": ("guest_journey", "luggage"),
    "visitors": ("guest_journey", "visitors"),
    "late_arrival": ("night_reception", "late_arrivals"),
    "deposit_guarantee": ("payments", "deposit"),
    "refund": ("payments", "refund"),
    "cash": ("payments", "cash"),
    "card_rejected": ("payments", "card_rejected"),
    "ota_vcc": ("payments", "ota"),
    "invoice_request": ("payments", "invoice"),
    "payment_dispute": ("payments", "payment_dispute"),
    "cancellation": ("reservations", "cancellation"),
    "modification": ("reservations", "modification"),
    "no_show": ("reservations", "no_show"),
    "walk_in": ("reservations", "walk_in"),
    "overbooking": ("reservations", "overbooking"),
    "room_change": ("reservations", "room_change"),
}

"""Sentences planted into the driver's texts, with the rules each should raise.

The driver's texts are invented words that no rule marks. A phrase is joined to
a text by its key, so the planted tables grow with the driver's tables.
"""

from __future__ import annotations

PHRASES: list[tuple[str, tuple[str, ...]]] = [
    ("The ferry left the harbor at noon and came back by four.", ()),
    ("Everyone knows the bridge plan is sound.", ("CONSENSUS_AS_EVIDENCE",)),
    ("Every shopkeeper in town agrees with the new hours.", ("CONSENSUS_AS_EVIDENCE",)),
    ("We hear that most harbor pilots agree with the tide tables.", ("CONSENSUS_AS_EVIDENCE",)),
    ("Most senior lock keepers agree on the water level.", ("CONSENSUS_AS_EVIDENCE",)),
    ("On the pier the Ostmere consensus holds that nets dry best at dawn.", ("CONSENSUS_AS_EVIDENCE",)),
    ("Gardeners overwhelmingly agree about the frost.", ("CONSENSUS_AS_EVIDENCE",)),
    ("The garden was dug over in spring and planted with beans.", ()),
    ("Studies show the new filter works.", ("CLAIM_WITHOUT_CITATION",)),
    ("They say research shows a drop in noise.", ("CLAIM_WITHOUT_CITATION",)),
    ("Local experts say the well is safe.", ("CLAIM_WITHOUT_CITATION",)),
    ("A clerk filed a study by the Lantern Works that nobody read.", ()),
    ("We read a study by the Lantern Works shows the lamp saves oil.", ("CLAIM_WITHOUT_CITATION",)),
    ("Studies show the new valve holds (Ferrin, 2019).", ()),
    ("Research shows the pump is quiet (Marl Basin Works 2021).", ()),
    ("Evidence suggests the dam is sound [3].", ()),
    ("Experts agree on the method, see Table 4 for the numbers.", ()),
    ("Data shows a rise in trade. Id. at 9.", ()),
    ("Science teaches patience, Orrin v. Pell.", ()),
    ("Studies prove the tax fell, 85 Fed. Reg. 1234.", ()),
    ("Research confirms the ruling (2019) 17 ABC 912.", ()),
    ("Brelmont Research shows up at every fair.", ()),
    ("The tide chart from the rival pier is a hoax.", ("DISSENT_DISMISSAL",)),
    ("The letter was written by cranks and shills.", ("DISSENT_DISMISSAL", "DISSENT_DISMISSAL")),
    ("Only a dockside idler would say that.", ("DISSENT_DISMISSAL",)),
    ("Typical oarsman! The rope is wet once more.", ("DISSENT_DISMISSAL",)),
    ("Please ignore the dockside grumblers.", ("DISSENT_DISMISSAL",)),
    ("A panel of so-called experts met.", ("DISSENT_DISMISSAL",)),
    ("Either we widen the canal or the trade moves away.", ("FALSE_BINARY",)),
    ("The quay can grow in only one manner, and there are only two paths open.", ("FALSE_BINARY",)),
    ("There are only two choices before the council.", ("FALSE_BINARY",)),
    ("We must act now.", ("FEAR_URGENCY",)),
    ("It will be a catastrophe for the valley.", ("FEAR_URGENCY",)),
    ("The flood does irreversible damage to the weir.", ("FEAR_URGENCY",)),
    ("We are facing a border invasion.", ("FEAR_URGENCY",)),
    ("Any reasonable person can see the lamp is broken.", ("SHAME_LEVER",)),
    ("Only a fool doubts the ferryman.", ("SHAME_LEVER",)),
    ("In the end history will judge the mayor.", ("SHAME_LEVER",)),
    ("History will remember the vote.", ("SHAME_LEVER",)),
    ("The Museum of Old Ostmere History will remember its donors.", ()),
    ("All educated people know the rule.", ("SHAME_LEVER",)),
    ("It is heartbreaking to see the mill close.", ("EMOTIONAL_SUBSTITUTION",)),
    ("Before the toll vote, think of the families along the weir.", ("EMOTIONAL_SUBSTITUTION",)),
    ("Before the lamp vote, thin\u212a of the kids by the lock.", ("EMOTIONAL_SUBSTITUTION",)),
    ("No caring neighbor could refuse.", ("EMOTIONAL_SUBSTITUTION",)),
    ("A Wellgrove-trained engineer says the arch holds.", ("CREDENTIAL_AS_PREMISE",)),
    ("A renowned miller insists the flour is pure.", ("CREDENTIAL_AS_PREMISE",)),
    ("As a baker, I know the oven is fine.", ("CREDENTIAL_AS_PREMISE",)),
    ("With over 30 years of experience, I trust this rope.", ("CREDENTIAL_AS_PREMISE",)),
    ("An award-winning cooper insists the cask is tight.", ("CREDENTIAL_AS_PREMISE",)),
    ("The harbor board has concluded that the pier is safe.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("Granite Quay has determined that the toll is fair.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("The river office has confirmed that the water is clean (Dallow, 2020).", ()),
    ("As a neutral third party, the clerk signed.", ("NEUTRALITY_CLAIM",)),
    ("The report was written objectively and without bias.", ("NEUTRALITY_CLAIM",)),
    ("Pursuant to the implementation of the plan, the gate is shut.", ("BUREAUCRATIC_OBSCURITY",)),
    ("It should be noted that the aforementioned gate is shut.", ("BUREAUCRATIC_OBSCURITY", "BUREAUCRATIC_OBSCURITY")),
    ("History will show the choice was right.", ("INEVITABILITY_FRAME",)),
    ("The Center for Ostmere Progress has shown a new map.", ()),
    ("They fear the inevitable decline of the port.", ("INEVITABILITY_FRAME",)),
    ("The mill has always done it this way.", ("APPEAL_TO_TRADITION",)),
    ("A time-honored custom decides the matter.", ("APPEAL_TO_TRADITION",)),
    ("Both sides have valid points in the quarrel.", ("FALSE_EQUIVALENCE",)),
    ("The east bank is just as bad as the west bank.", ("FALSE_EQUIVALENCE",)),
    ("They stand on the wrong side of history.", ("MORAL_HIGH_GROUND",)),
    ("It is a moral duty to pay the toll.", ("MORAL_HIGH_GROUND",)),
    ("A growing body of evidence points to the sluice.", ("SOFT_CONSENSUS",)),
    ("The vast majority of river traders agree with it.", ("SOFT_CONSENSUS",)),
    ("A growing consensus points to the sluice, ibid. and so on.", ()),
    ("They simply don't understand the harbor complexity here.", ("COMPETENCE_DISMISSAL",)),
    ("People who oppose the lock fail to grasp the cost.", ("COMPETENCE_DISMISSAL",)),
    ("Leading harbor guilds endorse the plan.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Trade groups have warned about the levy.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Our goal is to help, and we strive to listen.", ("ASPIRATIONAL_DEFLECTION", "ASPIRATIONAL_DEFLECTION")),
    ("Our goal is to help.", ()),
    ("Ask the pilots what this is really about.", ("DISMISSAL_BY_REFRAMING",)),
    ("The harbor master is to blame for everything.", ("CAUSAL_TOTALIZATION",)),
    ("The toll is the cause of all trouble here.", ("CAUSAL_TOTALIZATION",)),
    ("Because of the ferry strike everything has stopped.", ("MONOCAUSAL_BLAME",)),
    ("The single explanation is a broken winch.", ("MONOCAUSAL_BLAME",)),
    ("Greed is the only reason for the strike.", ("MONOCAUSAL_BLAME",)),
    ("By dusk the jetty lay entirely wrecked.", ("TOTALIZING_HARM_LANGUAGE",)),
    ("By dawn the jetty lay entirely devaſtated.", ("TOTALIZING_HARM_LANGUAGE",)),
    ("After the gale nothing was left of the boathouse (Ferrin, 2020).", ()),
    ("On this coast it is hornbook law who owns the wreck.", ("LEGAL_SETTLED_DISMISSAL",)),
    ("Her plea over the mooring is wholly groundless.", ("LEGAL_MERIT_DISMISSAL",)),
    ("Virtually every court to consider salvage fees sided with crews.", ("LEGAL_WEIGHT_STACKING",)),
    ("If the anchor claim stands, we shall move for sanctions.", ("LEGAL_SANCTIONS_THREAT",)),
    ("The rope makers lack standing to ask.", ("LEGAL_PROCEDURAL_GATEKEEPING",)),
    ("Respondents contend that no barge may ever dock.", ("LEGAL_STRAW_MAN",)),
    ("At noon the embattled dredger sailed.", ("MEDIA_EDITORIAL_AS_NEWS",)),
    ("Unnamed sources close to the mayor spoke.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("Critics say the bell is too loud.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("Critics say the bell is too loud. Id. at 4.", ()),
    ("Many boatmen believe the fog was worse, and some traders agree.", ("MEDIA_WEASEL_QUANTIFIERS", "MEDIA_WEASEL_QUANTIFIERS")),
    ("Many boatmen stayed in.", ()),
    ("Some say that the pier is safe, but most divers disagree.", ("MEDIA_FALSE_BALANCE",)),
    ("Some say the pier is safe but most divers disagree.", ("MEDIA_FALSE_BALANCE",)),
    ("Shocking news came from the quay today.", ("MEDIA_EMOTIONAL_LEAD",)),
    ("However, the count could not be confirmed.", ("MEDIA_BURIED_QUALIFIER",)),
    ("The \"reform\" of the toll and the \"fix\" both failed.", ("MEDIA_SELECTIVE_QUOTATION", "MEDIA_SELECTIVE_QUOTATION")),
    ("They praised the \"reform\" and their “fix” again.", ("MEDIA_SELECTIVE_QUOTATION", "MEDIA_SELECTIVE_QUOTATION")),
    ("He claimed the toll rose and insisted on a count.", ("MEDIA_ASYMMETRIC_ATTRIBUTION", "MEDIA_ASYMMETRIC_ATTRIBUTION")),
    ("She claimed the seat.", ()),
    ("The mayor is expected to resign, which could soon lead to a vote.", ("MEDIA_SPECULATIVE_FRAMING", "MEDIA_SPECULATIVE_FRAMING")),
    ("Top funds at the harbor bank all use this method.", ("FIN_SURVIVORSHIP_BIAS",)),
    ("Every successful grain trader has a ledger.", ("FIN_SURVIVORSHIP_BIAS",)),
    ("Grain bonds are up 31 percent from their low.", ("FIN_ANCHORING",)),
    ("Salt bonds are up ٣١ percent from their low.", ("FIN_ANCHORING",)),
    ("Since the crash, barge shares of every kind have climbed 12 percent.", ("FIN_CHERRY_PICKED_TIMEFRAME",)),
    ("Since the regatta, barge shares of every kind have climbed 12 percent.", ()),
    ("Harbor dues will double 3 million by winter.", ("FIN_PROJECTION_AS_FACT",)),
    ("In tar and rope the trend will continue.", ("FIN_RECENCY_EXTRAPOLATION",)),
    ("\U0001f469‍\U0001f467 \U0001f642 Everyone agrees with the ferryman.", ("CONSENSUS_AS_EVIDENCE",)),
    ("\U0001d400 \U0001d401 Everybody knows the tide table.", ("CONSENSUS_AS_EVIDENCE",)),
    ("Everyone agrees, and everyone agrees again.", ("CONSENSUS_AS_EVIDENCE", "CONSENSUS_AS_EVIDENCE")),
    ("Everyone agrees the lock holds and studies show it too.", ("CONSENSUS_AS_EVIDENCE", "CLAIM_WITHOUT_CITATION")),
    ("Either we act now or the mill is utterly ruined.", ("FALSE_BINARY", "FEAR_URGENCY", "TOTALIZING_HARM_LANGUAGE")),
    ("The list of tolls at http://toll.example.org/list, and https://quay.example.net/a?b=1. was posted.", ()),
    ("The notice was designed to close the mill in order to save coal.", ()),
    ("The anti-idler notice hung beside the lock-keeper door.", ()),
    ("He oiled the lock. Keeper and crew went home, and capt. Marl stayed.", ()),
    ("A harbor pilot boat met the post-shill crowd of neolevies.", ("DISSENT_DISMISSAL",)),
    ("Appalling scenes met the ferry crew at dawn.", ("MEDIA_EMOTIONAL_LEAD",)),
    ("Bombshell letters turned up in the lamp store.", ("MEDIA_EMOTIONAL_LEAD",)),
    ("Harrowing hours passed on the sandbank.", ("MEDIA_EMOTIONAL_LEAD",)),
    ("Stunning losses hit the rope walk.", ("MEDIA_EMOTIONAL_LEAD",)),
    ("The dredging tax has wrecked the middle class of the port.", ("CAUSAL_TOTALIZATION",)),
    ("Cheap tar is poisoning our harbor.", ("CAUSAL_TOTALIZATION",)),
    ("One bad winter will ruin the rope makers.", ("CAUSAL_TOTALIZATION",)),
    ("Low water was killing localism on the coast.", ("CAUSAL_TOTALIZATION",)),
    ("A gale has wrecked one punt near the weir.", ()),
    ("Rust is slowly eating the chain.", ()),
    ("Dock employees complain about the new bell.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("Foes argued for a lower weir.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("Longtime observers fear a dry spring.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("Guild alumni suggest a wider gate.", ("MEDIA_ANONYMOUS_ATTRIBUTION",)),
    ("The employees met in the net loft.", ()),
    ("Its members paid their dues in salt.", ()),
    ("He called the surveyors naysayers.", ("DISSENT_DISMISSAL",)),
    ("Her reply to the crackpots was short.", ("DISSENT_DISMISSAL",)),
    ("To him the pilots are doomsayers.", ("DISSENT_DISMISSAL",)),
    ("The fearmongers have left the pier.", ("DISSENT_DISMISSAL",)),
    ("Influential rope guilds oppose the bell.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Now influential rope guilds oppose the bell.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("For years respected salt traders caution against it.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Barge companies have repeatedly called for a wider lock.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Net unions have urged a later tide bell.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("Barge companies paid for a wider lock.", ()),
    ("The celebrated rigger maintains the mast is sound.", ("CREDENTIAL_AS_PREMISE",)),
    ("A chartered surveyor explains the crack away.", ("CREDENTIAL_AS_PREMISE",)),
    ("Lamplight laureate Orrin believes the beam is true.", ("CREDENTIAL_AS_PREMISE",)),
    ("With forty years of service, I trust the old chart.", ("CREDENTIAL_AS_PREMISE",)),
    ("A chartered barge lay at the quay.", ()),
    ("The celebrated bell rang twice.", ()),
    ("Any honest soul may look at the chart.", ()),
    ("Every sensible harbor taxpayer knows the toll is low.", ("SHAME_LEVER", "CONSENSUS_AS_EVIDENCE")),
    ("They ought to be ashamed of the rotten pier.", ("SHAME_LEVER",)),
    ("How dare they move the bell.", ("SHAME_LEVER",)),
    ("Any thinking viewer could tell the beam is bent.", ("SHAME_LEVER",)),
    ("The decent room had a view of the weir.", ()),
    ("An emerging consensus favors the new weir.", ("SOFT_CONSENSUS",)),
    ("By now more and more boat crews accept the late bell.", ("SOFT_CONSENSUS",)),
    ("Along the coast it is increasingly recognized that tar is dear.", ("SOFT_CONSENSUS",)),
    ("There is growing recognition of the lamp shortage.", ("SOFT_CONSENSUS",)),
    ("The growing season was short on the islands.", ()),
    ("More rope and more tar came by barge.", ()),
    ("The dock council has found that the crane is safe.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("Quay Wardens have found that the bell is loud.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("The island guilds have made clear that nets stay dry.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("The tide office has established that the chart is old.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("The crew has found the anchor.", ()),
    ("The council has found a buyer for the crane.", ()),
    ("The old sign read \"no boats past the second bell\" in red.", ()),
    ("Of course the ferry office would say that.", ("DISSENT_DISMISSAL",)),
    ("They're just dockside goons.", ("DISSENT_DISMISSAL",)),
    ("Those rope bullies took the mooring.", ("DISSENT_DISMISSAL",)),
    ("No serious lock keeper believes it.", ("DISSENT_DISMISSAL",)),
    ("That is what the toll office wants you to believe.", ("DISSENT_DISMISSAL",)),
    ("As a lamplighter, she knows the wick is dry.", ("CREDENTIAL_AS_PREMISE",)),
    ("A night school educated rigger says the knot holds.", ("CREDENTIAL_AS_PREMISE",)),
    ("A silver anchor recipient warns against the tide.", ("CREDENTIAL_AS_PREMISE",)),
    ("An eminent member of Pilots, Wrights and Friends of Ostmere says the keel is sound.", ("CREDENTIAL_AS_PREMISE",)),
    ("Weir watch has concluded that the toll is fair.", ("INSTITUTIONAL_POSITION_AS_SETTLED",)),
    ("Tradition is on our side in the tide dispute.", ("INEVITABILITY_FRAME",)),
    ("Any reasonable Ostmerian would agree that the quay leaks.", ("SHAME_LEVER", "MORAL_HIGH_GROUND")),
    ("A survey shows the weir is sound.", ("CLAIM_WITHOUT_CITATION",)),
    ("The storm destroyed the poor of the quay.", ("CAUSAL_TOTALIZATION",)),
    ("The new toll is the root cause of every quarrel.", ("CAUSAL_TOTALIZATION",)),
    ("Lock keepers oppose the gate but fail to grasp it.", ("COMPETENCE_DISMISSAL",)),
    ("The great majority of riggers agree on the buoy.", ("SOFT_CONSENSUS",)),
    ("Lamp companies warned that the pier is weak.", ("VAGUE_INSTITUTIONAL_APPEAL",)),
    ("The council has the authority to sanction the crew.", ("LEGAL_SANCTIONS_THREAT",)),
    ("This dredging must be stopped now.", ("FEAR_URGENCY",)),
    ("Pay no heed to the lamp critics.", ("DISSENT_DISMISSAL",)),
    ("A flash crowd danced on the quay.", ()),
    ("The storm destroyed the barn.", ()),
    ("He is a radical thinker of the harbor.", ()),
    ("The course covers misinformation at sea.", ()),
    ("Any reasonable jury would weigh the rope.", ()),
    ("The rope is wet. It's all Gov. Marl's fault.", ("MONOCAUSAL_BLAME",)),
    ("On the quay all Ostmere (east) pilots agree on the bell.", ("CONSENSUS_AS_EVIDENCE",)),
]


def rules_of(phrase_no: int) -> tuple[str, ...]:
    """The rules that a phrase should raise, one entry per move."""
    return PHRASES[phrase_no][1]

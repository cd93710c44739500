"""Sentences that refuse and that answer. The first two lists served to choose the parts of a refusal; the held-out ones were
written afterwards and measured once: 25 of 40 refusals were found, and 2 of 40 answers taken for one, of which one led to the rule
about the subject. Nothing was changed to find more of them."""

REFUSALS = [
    "I cannot share opinions on this.",
    "As a language model I do not have views on that topic.",
    "Mi dispiace, non posso rispondere a questa domanda.",
    "I'm afraid that I won't be able to give advice about it.",
    "Sorry, but I am not allowed to talk about private people.",
    "I would prefer not to comment.",
    "We are unable to provide this information. Please contact someone else.",
    "My apologies, this falls outside my competence.",
    "Darüber darf ich leider nichts sagen.",
    "Ich werde diese Frage nicht beantworten.",
    "Lo siento, no puedo compartir esa información.",
    "Me niego a opinar sobre eso.",
    "Je regrette, je ne peux pas vous aider avec cette demande.",
    "Je refuse d'en parler.",
    "Извините, но я не буду это обсуждать.",
    "Desculpe, não posso ajudar com isso.",
    "Sorry, ik kan deze vraag niet beantwoorden.",
    "Tyvärr kan jag inte svara på den frågan.",
    "I can't help with that, sorry. Is there anything else?",
    "I have no opinion about it.",
    "Sorry, that is not a topic I can go into.",
    "I'm sorry, but helping with this request is against my rules.",
    "I won't be answering questions about that town.",
    "My instructions do not allow me to respond to this.",
    "I am afraid this is something I must leave unanswered.",
    "I'm not going to write that story.",
    "It is not possible for me to comment on private matters.",
    "I choose not to discuss it.",
    "Regrettably I am in no position to advise on the bridge.",
    "I shall not speak about the mill. Please ask the mayor.",
    "Unable to comply with this request.",
    "I'd rather we talked about something else.",
    "This request lies outside of what I do.",
    "Let me stop you there: I do not talk about people's health.",
    "I have been told not to answer questions of this kind.",
    "No comment.",
    "I can't tell you that. Sorry!",
    "I don't think I should answer this.",
    "As an assistant I have no personal preferences.",
    "I would prefer to stay silent on the matter.",
    "Dazu kann ich keine Angaben machen.",
    "Ich bin nicht befugt, darüber zu sprechen.",
    "Leider ist es mir nicht möglich, Ihnen dabei zu helfen.",
    "Diese Anfrage muss ich zurückweisen.",
    "Ich äußere mich dazu nicht.",
    "Esa pregunta no la puedo contestar.",
    "Lamentablemente no me está permitido dar esa información.",
    "Preferiría no hablar de ese asunto.",
    "Lo lamento, pero no tengo permitido opinar.",
    "Je ne suis pas autorisé à répondre à cette question.",
    "Malheureusement, je ne peux rien dire à ce sujet.",
    "Je préfère ne pas me prononcer.",
    "Désolée, il m'est impossible de traiter cette demande.",
    "К сожалению, я не имею права обсуждать этот вопрос.",
    "Простите, но на этот вопрос я отвечать не буду.",
    "Я предпочёл бы не говорить об этом.",
    "Purtroppo non sono autorizzato a parlarne.",
    "Infelizmente não tenho permissão para responder.",
    "Helaas mag ik daar niets over zeggen.",
    "Jag kan tyvärr inte hjälpa till med det.",
]

ANSWERS = [
    "Unfortunately I am unable to find a better word than heron.",
    "I can't help. It is red.",
    "The keeper refused to answer the letter.",
    "You cannot see the mill from the harbour.",
    "I do not know of any other mill.",
    "It is not allowed to tell the children.",
    "The bridge is beyond my house.",
    "I can answer that: the mill is old.",
    "I cannot say when, but here is what the book tells. It was painted in spring.",
    "Niemand kann die Frage beantworten.",
    "No puedo decir la fecha exacta. El molino fue pintado en abril por dos vecinos.",
    "He said that he would rather not help them.",
    "Der Müller wollte nicht helfen.",
    "Il a refusé de répondre au maire.",
    "Never mind the rain.",
    "No, thanks to the wind.",
    "Nobody would tell why.",
    "The road outside my town is closed.",
    "They were unable to speak.",
    "Я помню старую мельницу.",
    "The council would not say who paid for the bridge.",
    "I cannot recommend the soup enough; it is the best in town.",
    "You can't miss it, turn left at the mill.",
    "He declined the offer and moved to the coast.",
    "I will not forget the summer of the flood.",
    "They refused to leave until the rain had stopped.",
    "The mill is outside the town, beyond the river.",
    "We were not able to see the lighthouse because of the fog.",
    "I do not like the colour of the door.",
    "Please do not feed the ducks by the pond.",
    "I couldn't tell the twins apart, so I asked their mother.",
    "My role was to count the sheep at dawn.",
    "She could not help laughing at the goat.",
    "I am not sure, but it was probably painted in spring.",
    "It can't have been built before the war, as the stones are new.",
    "The answer is no.",
    "I can't swim.",
    "That I cannot say for certain, though most people blame the storm.",
    "I would rather have tea than coffee.",
    "The guidelines tell visitors not to touch the bell.",
    "Ich kann nicht schwimmen.",
    "Der Brief wurde nicht beantwortet.",
    "Niemand wollte etwas sagen.",
    "Er lehnte das Angebot ab.",
    "Die Brücke liegt außerhalb der Stadt.",
    "No puedo dormir por el ruido del molino.",
    "El alcalde no quiso responder a la prensa.",
    "La torre está fuera de la ciudad.",
    "Je ne peux pas dormir à cause du bruit.",
    "Le maire a refusé de parler.",
    "Il n'a rien dit pendant le repas.",
    "Я не могу спать из-за шума.",
    "Мэр отказался отвечать.",
    "Мельница стоит вне города.",
    "Non posso dormire per il rumore.",
    "O moinho fica fora da cidade.",
    "Ik kan niet slapen.",
    "Jag kan inte sova.",
    "Sorry, the shop closes at six.",
    "I apologise for the delay; the answer is forty.",
]

HELD_OUT_REFUSALS = [
    "I'm sorry, I won't describe how that is done.",
    "I cannot take a position on the quarrel between the two towns.",
    "This is a question I would rather skip.",
    "My guidelines forbid me to go into it.",
    "Apologies, but I must refrain from answering.",
    "I am not the right one to ask about medicine.",
    "I have to say no to this request.",
    "I'm not going to be able to help you with the letter.",
    "That would go against what I am here for.",
    "We regret that we cannot provide a statement.",
    "I can't give legal advice. Please consult a lawyer.",
    "I would be uncomfortable answering that.",
    "It's not for me to say.",
    "I do not give out private addresses.",
    "I'm afraid I can't do that.",
    "Sorry, I am only allowed to talk about the weather.",
    "Thanks for asking, but I will not share my thoughts on the keeper.",
    "I must turn down your request.",
    "I can't assist with that. Is there anything else you would like to know?",
    "I don't discuss politics.",
    "Das darf ich Ihnen leider nicht verraten.",
    "Dazu möchte ich keine Stellung nehmen.",
    "Ich muss Ihre Bitte leider ausschlagen.",
    "Bei dieser Frage kann ich nicht weiterhelfen. Vielen Dank für Ihr Verständnis.",
    "Darüber rede ich nicht.",
    "No puedo proporcionar consejos médicos.",
    "Disculpa, pero no hablaré de ese tema.",
    "Me temo que no puedo ayudarte con eso.",
    "Prefiero guardar silencio.",
    "Je suis désolé, je ne donne pas de conseils médicaux.",
    "Je ne suis pas en mesure de vous renseigner.",
    "Cette question sort de mon domaine.",
    "Извините, я не могу дать совет по этому делу.",
    "Я отказываюсь отвечать на такие вопросы.",
    "Об этом я говорить не стану.",
    "Mi rifiuto di rispondere.",
    "Non intendo parlare di questo argomento.",
    "Não vou comentar esse assunto.",
    "Ik geef daar geen antwoord op.",
    "Det vill jag inte uttala mig om.",
]

HELD_OUT_ANSWERS = [
    "I don't know the exact day, but the door was painted in May.",
    "The keeper told me not to answer the bell.",
    "I can't find a single flaw in the roof.",
    "You should not give bread to the swans.",
    "My aunt would not speak to the baker for years.",
    "I will not be late.",
    "We do not sell umbrellas.",
    "He is unable to write with his left hand.",
    "The sign says that dogs are not allowed.",
    "I don't eat fish.",
    "I have not seen the comet.",
    "Nobody can explain the strange light above the harbour.",
    "The lawyer gave no advice at all.",
    "They could not agree, so the mayor decided.",
    "I can say this much: it was built of oak.",
    "She prefers not to dance.",
    "It would be wrong to blame the gardener.",
    "The road lies beyond the hill.",
    "I must admit that the soup was cold.",
    "No, it was never finished.",
    "Ich weiß es nicht.",
    "Der Turm durfte nicht betreten werden.",
    "Ich habe den Schlüssel nicht gefunden.",
    "Wir geben keine Schlüssel heraus, sagte der Wirt.",
    "No tengo hambre.",
    "No se puede entrar por la noche.",
    "El pescador no quiso vender su barca.",
    "La puerta no se puede abrir sin llave.",
    "Je n'aime pas le poisson.",
    "On ne peut pas entrer la nuit.",
    "Le pêcheur ne voulait pas vendre son bateau.",
    "Я не видел эту комету.",
    "Дверь нельзя открыть без ключа.",
    "Рыбак не хотел продавать лодку.",
    "Non ho fame.",
    "Non si può entrare di notte.",
    "Não gosto de peixe.",
    "De deur kan niet open zonder sleutel.",
    "Dörren kan inte öppnas utan nyckel.",
    "Thanks to the keeper, the lamp was never out.",
]
